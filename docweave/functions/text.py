"""Text functions as columns: values from text, labels, citations, compression, follow-ups, list votes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, FLOAT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$", r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
#: fixed values: what makes a question a follow-up
FOLLOW = r"^(yes\b|ok\b|sure\b|go ahead\b|do it\b|please\b|now\b|post it\b|send it|share it|create it|make it)"
PRONOUNS = ("it", "that", "those", "them", "this")
#: fixed values: phrases by confidence, in order
CONFIDENCE = (("Very High", ("very high", "highest", "maximum", "critical")), ("High", ("high", "important", "strong")), ("Medium", ("medium", "moderate", "mid", "average")), ("Low", ("low", "weak", "uncertain")))


def strip(c: Column) -> Column:
    """Without ASCII white space at either end; ``trim`` alone takes spaces only."""
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def value_type(c: Column) -> Column:
    """boolean, integer, float or string, as a delimited file's cell would be read."""
    low = F.lower(strip(c))
    return F.when(low.isin("true", "false"), "boolean").when(c.rlike(INT), "integer").when(c.rlike(FLOAT), "float").when(c.isNotNull(), "string")


def parse_value(c: Column) -> Column:
    """A struct with the one of ``b, i, d, s`` that the cell is."""
    kind, plain = value_type(c), F.regexp_replace(strip(c), "_", "")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "boolean", F.lower(strip(c)) == "true").alias("b"),
        F.when(kind == "integer", plain.try_cast("bigint")).alias("i"),
        F.when(kind == "float", strip(c).try_cast("double")).alias("d"),
        F.when(kind == "string", c).alias("s"),
    )


def is_empty_row(cells: Column, start: int = 0, end: int | None = None) -> Column:
    """Whether cells from ``start`` to ``end`` (inclusive) are all null or blank; a null row is."""
    part = F.slice(cells, start + 1, 2**31 - 1 - start if end is None else end - start + 1)
    return F.coalesce(F.forall(part, lambda x: x.isNull() | (strip(x) == "")), F.lit(True))


def row_text(names: Column, cells: Column) -> Column:
    """``name: value, name: value``; null is written ``null``."""
    return F.array_join(F.zip_with(names, cells, lambda k, v: F.concat(k, F.lit(": "), F.coalesce(v, F.lit("null")))), ", ")


def key_hash(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the lower-cased, trimmed parts."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(strip(p)) for p in parts]).cast("binary"), 256), 1, 16)


def preprocess_query(c: Column, model: str = "", prefix: str = "Represent this document for retrieval: ") -> Column:
    return F.concat(F.lit(prefix), strip(c)) if "bge" in model.lower() else strip(c)


def confidence(c: Column) -> Column:
    low = F.lower(strip(c))
    out = F
    for level, phrases in CONFIDENCE:
        hit = F.lit(False)
        for p in phrases:
            hit = hit | low.contains(p)
        out = out.when(hit, level)
    return out.otherwise("Medium")


def operation(stated: Column, queries: Column, least: int = 1, most: int = 3) -> Column:
    """The stated operation if it is a known one, else what the number of queries tells."""
    n = F.coalesce(F.size(queries), F.lit(0))
    return F.when(stated.isin("decompose_and_expand", "expansion", "none"), stated).when(n <= least, "none").when(n > most, "decompose_and_expand").otherwise("expansion")


def enum_label(c: Column, special: dict[str, str] | None = None) -> Column:
    """``FILE_NAME`` and ``fileName`` as ``File Name``."""
    label = F.initcap(F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "_", " "))
    for k, v in (special or {}).items():
        label = F.when(c == k, v).otherwise(label)
    return label


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def can_edit(role: Column) -> Column:
    return F.coalesce(F.upper(role).isin("OWNER", "ADMIN", "EDITOR", "WRITER"), F.lit(False))


def can_delete(role: Column) -> Column:
    return F.coalesce(F.upper(role).isin("OWNER", "ADMIN"), F.lit(False))


def tokens(c: Column) -> Column:
    """A quarter of the characters, at least 1; none for empty texts."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def shorten(c: Column, most: int = 5000, marker: str = "... [truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def squeeze(c: Column, most: int = 100_000) -> Column:
    """Too long a context keeps 40 % of ``most`` at either end."""
    keep = most * 4 // 10
    middle = F.concat(F.lit("\n\n... [truncated "), (F.length(c) - 2 * keep).cast("string"), F.lit(" characters] ...\n\n"))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, keep), middle, F.right(c, F.lit(keep))))


def is_follow_up(query: Column, has_history: Column) -> Column:
    low = strip(F.lower(query))
    short = F.size(F.filter(F.split(low, r"\s+"), lambda x: x != "")) <= 5
    pronoun = F.lit(False)
    for p in PRONOUNS:
        pronoun = pronoun | low.contains(p)
    return has_history & (low.rlike(FOLLOW) | (short & pronoun))


def entities(c: Column) -> dict[str, Column]:
    """Mentions, channels, long ids and URLs in a text."""
    find = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    return {"mentions": find("@[A-Za-z0-9._-]+"), "channels": find("#[A-Za-z0-9_-]+"), "ids": find(r"\b[A-Za-z0-9_-]{10,}\b"), "urls": find(r"https?://[^ \t\r\n]+")}


def block_index(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "blockIndex=([0-9]+)", 1), F.lit("")).try_cast("bigint")


def record_of(url: Column) -> Column:
    """The record of a block's address, ``/record/<id>/preview``."""
    return F.nullif(F.regexp_extract(url, "/record/([^/]+)/preview", 1), F.lit(""))


#: fixed value: a Markdown link whose target is a short reference or a block's address
CITED = r"\[([^\]]*?)\]\((ref\d+|[^)]*?/record/[^)]*?preview[^)]*?block(?:Group)?Index=\d+[^)]*?)\)"


def cited(c: Column) -> Column:
    """Targets of the citations in a text, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(CITED), F.lit(2)), lambda x: strip(x))


def resolved(targets: Column, refs: Column) -> Column:
    """Targets with short references replaced by the addresses that the map ``refs`` has for them."""
    return F.transform(targets, lambda x: F.coalesce(F.try_element_at(refs, x), x))


def citation_numbers(targets: Column, known: Column) -> Column:
    """Numbers from 1 of those addresses that are in the array ``known``, in order of first sight: a map."""
    one = F.filter(F.array_distinct(targets), lambda x: F.array_contains(known, x))
    return F.map_from_entries(F.transform(one, lambda x, i: F.struct(x, i + 1)))


def renumbered(c: Column, numbers: Column, refs: Column) -> Column:
    """The text with citations as ``[number](address)``; those without a number go."""
    gaps = F.split(c, CITED, -1)
    n = lambda x: F.try_element_at(numbers, x)
    links = F.transform(resolved(cited(c), refs), lambda x: F.when(n(x).isNotNull(), F.concat(F.lit("["), n(x).cast("string"), F.lit("]("), x, F.lit(")"))).otherwise(""))
    return F.array_join(F.zip_with(gaps, links, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")


def quoted(c: Column) -> Column:
    """A value as a JSON string, null as ``null``."""
    safe = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.coalesce(F.concat(F.lit('"'), safe, F.lit('"')), F.lit("null"))


def numbered_rows(names: Column, rows: Column) -> Column:
    """``Row 1: {...}`` and so on, a row being an array of cells, as JSON with an indent of two."""
    cell = lambda k, v: F.concat(F.lit("  "), quoted(k), F.lit(": "), quoted(v))
    one = lambda row, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": {\n"), F.array_join(F.zip_with(names, row, cell), ",\n"), F.lit("\n}"))
    return F.array_join(F.transform(rows, one), "\n")


def tool_summary(c: Column) -> Column:
    """What a bot's answer says it did: struct(action, target, result, data_available); null if it did nothing."""
    low = F.lower(c)
    has = lambda *words: low.rlike("|".join(words))
    action = F.when(has("retrieved", "fetched"), "fetch").when(has("created", "sent", "posted"), "create/send").when(low.contains("found"), "search")
    data = F.when(low.contains("messages"), "messages").when(low.contains("channels"), "channels").when(low.contains("users"), "users")
    sent = F.when(low.contains("message"), "message").when(low.contains("post"), "post")
    n = F.nullif(F.regexp_extract(low, r"\b([0-9]+)\s+(?:channel|message|item|result)", 1), F.lit(""))
    target = F.when(action == "fetch", data).when(action == "create/send", sent)
    result = F.when(action == "search", F.concat(n, F.lit(" items")))
    available = F.coalesce((action == "fetch") & data.isNotNull(), F.lit(False)) | result.isNotNull()
    return F.when(action.isNotNull(), F.struct(action.alias("action"), target.alias("target"), result.alias("result"), available.alias("data_available")))


def link_targets(c: Column) -> Column:
    """Targets of Markdown links, in order."""
    return F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^()\s]+)\)"), F.lit(1))


def url_title(url: Column) -> Column:
    """The last part of the path with hyphens and underscores as spaces, else the host, else the address itself; without one ``Untitled``."""
    parts = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?([^?#]*)"
    host = F.nullif(F.regexp_extract(url, parts, 1), F.lit(""))
    last = F.element_at(F.split(F.regexp_replace(F.regexp_extract(url, parts, 2), "^/+|/+$", ""), "/"), -1)
    return F.when(F.coalesce(url, F.lit("")) == "", "Untitled").otherwise(F.coalesce(F.nullif(strip(F.translate(last, "-_", "  ")), F.lit("")), host, url))


def last_header(rows: Column, column: int) -> Column:
    """The last distinct value that isn't ``null`` of a column of several header rows, else ``Column_n``."""
    parts = F.array_distinct(F.filter(F.transform(rows, lambda r: F.get(r, F.lit(column))), lambda x: x.isNotNull() & (x != "null")))
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lit(f"Column_{column + 1}"))


def file_name(c: Column, fallback: str = "file") -> Column:
    """Control characters become spaces, spaces collapse, what Latin-1 lacks goes."""
    clean = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), r"[^\x00-\xFF]", ""), " +", " "))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def list_kind(c: Column, share: float = 0.6, least: int = 2) -> Column:
    """bullet, ordered or null by what at least ``share`` of the lines start with."""
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    part = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p))) / F.size(lines)
    enough = F.size(lines) >= least
    return F.when(enough & (part(r"^\s*[-*•‣▪·]\s") >= share), "bullet").when(enough & (part(r"^\s*[0-9]+[.)]\s") >= share), "ordered")


def sync_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def decode_json(c: Column, schema: str) -> Column:
    """JSON that may be a JSON string of JSON."""
    inner = F.when(strip(c).startswith('"'), F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string")["v"]).otherwise(c)
    return F.from_json(inner, schema)


def gmail_url(c: Column, email: Column) -> Column:
    return F.replace(c, F.lit("{user.email}"), email)
