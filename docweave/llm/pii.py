"""Personal data in whole texts, with DataFrame functions only.

Regular expressions propose spans; checks confirm them (octets at most 255, Luhn, mod-97, digit counts); context words
in the ``NEAR`` characters before and after a span adjust its score. The four base kinds keep every confirmed span whatever its
score; the added kinds ``iban`` and ``ssn`` keep spans of ``LEAST`` or more.

The patterns are the defining ones rewritten without changing a match so that the JVM needs linear time and no
recursion on long texts: possessive repeats, and look-behinds that start a match only where a run starts or the
last match ended (``\\G``).

Places come from prefix sums by blocks, so a text of many spans needs time near linear in its length.

Cases: null text counts as empty and has no spans. Offsets are code points, end exclusive. Kinds may overlap;
redaction merges what overlaps. Other input columns are kept by ``redact`` and ignored by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR, LEAST = 40, 0.5
LOCAL = "[A-Za-z0-9._%+-]"
PROPOSE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
BASE = ("email", "ip", "card", "phone")
#: cheap tests that a text without the kind fails
MAY = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
MAY_MATCH = {"card": r"[0-9][\x20-]?[0-9]", "iban": "[0-9]{2}"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = {
    "email": r"mail|contact|write|e-mail",
    "ip": r"\bip\b|address|host|server",
    "card": r"card|visa|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|appel|anruf",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "ssn": r"ssn|social security|taxpayer",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def mod97(match: Column) -> Column:
    """The ISO 7064 remainder of an account number, its first four characters moved to the end."""
    plain = F.regexp_replace(match, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _valid(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(match) == 1
    if kind == "ssn":
        return ~match.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _prefix(values: Column, total, zero: int = 0, block: int = 128) -> Column:
    """The running totals of an array of numbers, by blocks."""

    def whole(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), F.lit(zero), total))
        before = lambda p: F.transform(p, lambda _, b: F.aggregate(F.slice(p, F.lit(1), b), F.lit(zero), total))
        own = lambda o: F.transform(v, lambda _, i: total(o[F.floor(i / block).cast("int")], F.aggregate(F.slice(v, i - i % block + 1, i % block + 1), F.lit(zero), total)))
        return _let(parts, lambda p: _let(before(p), own))

    return _let(values, whole)


def _spans(kind: str, text: Column) -> Column:
    """The kind's confirmed spans: array of struct(kind, start, end, score)."""
    pattern = F.lit(PROPOSE[kind])

    def placed(found, gaps):
        lengths = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g))
        # there is one gap more than matches
        near = lambda i: F.concat_ws(" ", F.when(i > 0, F.substring(gaps[F.greatest(i - 1, F.lit(0))], -NEAR, NEAR)), F.substring(gaps[i], -NEAR, NEAR), F.substring(gaps[i + 1], 1, NEAR))
        row = lambda ends: F.transform(found, lambda m, i: F.struct(m.alias("m"), (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), near(i).alias("near")))
        return _let(_prefix(lengths, lambda a, x: a + x), row)

    def scored(x):
        score = F.when(F.lower(x["near"]).rlike(CONTEXT[kind]), F.least(F.lit(1.0), F.lit(PRIOR[kind] + 0.3))).otherwise(F.lit(PRIOR[kind]))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score.alias("score"))

    rows = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: _let(F.split(text, PROPOSE[kind], -1), lambda gaps: placed(found, gaps)))
    rows = F.transform(F.filter(rows, lambda x: _valid(kind, x["m"])), scored)
    if kind not in BASE:
        rows = F.filter(rows, lambda x: x["score"] >= LEAST)
    may = text.contains(MAY[kind]) if kind in MAY else text.rlike(MAY_MATCH[kind])
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(may, rows).otherwise(none)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and for each kind an array column of its spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), *[_spans(k, text).alias(k) for k in PROPOSE])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    found = find(docs)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(F.concat(*BASE)), 256).alias("base_sha256"),
        _joined(F.concat(*PROPOSE)).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", piece: int = 512) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; overlapping spans are replaced
    together, under the first one's kind. A null text stays null; all other columns stay as they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.transform(F.concat(*[_spans(k, text) for k in PROPOSE]), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    name = "_spans"
    while name in docs.columns:
        name += "_"

    def clean(spans, pieces, reach):
        """``reach``: the greatest end of each span and those before it."""

        def between(a, z):
            some = F.slice(pieces, F.floor(a / piece).cast("int") + 1, (F.floor(z / piece) - F.floor(a / piece)).cast("int") + 1)
            return F.substring(F.array_join(some, ""), a % piece + 1, z - a)

        before = lambda i: F.when(i > 0, reach[F.greatest(i - 1, F.lit(0))]).otherwise(F.lit(0))
        rows = F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), before(i).alias("at")))
        apart = F.filter(rows, lambda x: x["start"] >= x["at"])
        marked = F.transform(apart, lambda x: F.concat(between(x["at"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.concat(F.array_join(marked, ""), between(F.element_at(reach, -1), F.length(text)))

    ends = F.transform(F.col(name), lambda x: -x["back"])
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    done = _let(F.col(name), lambda s: _let(pieces, lambda p: _let(_prefix(ends, lambda a, x: F.greatest(a, x)), lambda reach: clean(s, p, reach))))
    marked = docs.withColumn(name, spans)
    # a text without spans is not copied
    return marked.withColumn(text_col, F.when(F.size(name) > 0, done).otherwise(F.col(text_col))).drop(name).select(*docs.columns)
