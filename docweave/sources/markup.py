"""Markdown and HTML rewriting and sentences, a text at a time in Arrow batches."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ATTR = r"""\b{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_HREF, _SRC = (re.compile(_ATTR.format(a), re.I) for a in ("href", "src"))
_ABSOLUTE = re.compile(r"^(https?:)//[^/?#]+", re.I)


def _value(pattern: re.Pattern, tag: str) -> str:
    m = pattern.search(tag)
    return next((g for g in m.groups() if g is not None), "") if m else ""


def base_url(html: str) -> str | None:
    """The page's base: its base element, else its canonical link's origin, else that of the first absolute URL of its links, scripts, images
    and anchors."""
    for tag in re.findall(r"<base\b[^>]*>", html, re.I):
        if _value(_HREF, tag):
            return _value(_HREF, tag)
    links = re.findall(r"<link\b[^>]*>", html, re.I)
    ways = [(t, _HREF) for t in links if re.search(r"rel\s*=\s*[\"']?canonical", t, re.I)]
    for name, pattern in (("link", _HREF), ("script", _SRC), ("img", _SRC), ("a", _HREF)):
        ways += [(t, pattern) for t in re.findall(rf"<{name}\b[^>]*>", html, re.I)]
    for tag, pattern in ways:
        m = _ABSOLUTE.match(_value(pattern, tag))
        if m:
            return m.group(0)
    return None


def absolute(html: str) -> str:
    """Relative image sources joined to the page's base; without a base nothing changes."""
    base = base_url(html)
    if not base:
        return html

    def turn(m: re.Match) -> str:
        tag, src = m.group(0), _value(_SRC, m.group(0))
        if not src or re.match(r"^(?:[a-z][a-z0-9+.-]*:|//)", src, re.I):
            return tag
        return tag.replace(src, urljoin(base if base.endswith("/") else base + "/", src), 1)

    return re.sub(r"<img\b[^>]*>", turn, html, flags=re.I)


def absolute_images(df: DataFrame, column: str) -> DataFrame:
    @F.pandas_udf("string")
    def turn(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else absolute(x))

    return df.withColumn(column, turn(column))


def numbered(md: str) -> tuple[str, list[dict]]:
    """Images renumbered ``Image_1`` and so on, reference style first, then inline, then HTML; and what they were."""
    defs = {k.lower(): u for k, u in re.findall(r"^[ ]{0,3}\[([^\]]+)\]:\s*<?([^\s>]+)", md, re.M)}
    seen: list[dict] = []

    def note(kind: str, alt: str, url: str) -> str:
        seen.append({"name": f"Image_{len(seen) + 1}", "alt": alt, "url": url, "kind": kind})
        return seen[-1]["name"]

    def by_reference(m: re.Match) -> str:
        key = (m.group(2) or m.group(1)).lower()
        return m.group(0) if key not in defs else f"![{note('reference', m.group(1), defs[key])}][{m.group(2) or m.group(1)}]"

    md = re.sub(r"!\[([^\]]*)\]\[([^\]]*)\]", by_reference, md)
    md = re.sub(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?((?:\s+\"[^\"]*\")?)\s*\)", lambda m: f"![{note('inline', m.group(1), m.group(2))}]({m.group(2)}{m.group(3)})", md)
    alt = re.compile(_ATTR.format("alt"), re.I)

    def by_html(m: re.Match) -> str:
        tag = m.group(0)
        if not _value(_SRC, tag):
            return tag
        name = note("html", _value(alt, tag), _value(_SRC, tag))
        return alt.sub(f'alt="{name}"', tag, count=1) if alt.search(tag) else tag[:4] + f' alt="{name}"' + tag[4:]

    return re.sub(r"<img\b[^>]*>", by_html, md, flags=re.I), seen


def number_images(df: DataFrame, column: str) -> DataFrame:
    """The text with numbered images, and ``images``."""
    kind = "struct<text string, images array<struct<name string, alt string, url string, kind string>>>"

    @F.pandas_udf(kind)
    def turn(s: pd.Series) -> pd.DataFrame:
        got = [numbered(x or "") for x in s]
        return pd.DataFrame({"text": [a for a, _ in got], "images": [b for _, b in got]})

    return df.withColumn("_m", turn(column)).withColumn(column, F.col("_m.text")).withColumn("images", F.col("_m.images")).drop("_m")


#: fixed values: what a full stop doesn't end a sentence after
SHORT = frozenset("mr mrs ms dr prof sr jr st vs etc inc ltd co corp dept fig no e.g i.e approx".split())


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences. No break after a number or a bullet at a line's start, an abbreviation, a single capital or an ellipsis, nor after an all-capitals
    heading without an end mark."""
    out, start = [], 0
    for m in re.finditer(r"(?:[.!?]+[\"')\]]*(?=\s)|\n\s*\n)\s*", text):
        before = text[start : m.start()]
        mark = m.group(0).strip()
        last = before.rsplit(None, 1)[-1] if before.strip() else ""
        word = last.lstrip("([\"'").lower()
        if mark.startswith("..") or (mark == "." and (word in SHORT or re.fullmatch(r"[0-9]+|[A-Za-z]|[-*•]", last))):
            continue
        span = text[start : m.end()]
        if span.strip():
            head = len(span) - len(span.lstrip())
            out.append((start + head, start + len(span.rstrip())))
        start = m.end()
    rest = text[start:]
    if rest.strip():
        out.append((start + len(rest) - len(rest.lstrip()), start + len(rest.rstrip())))
    return out


def sentences(df: DataFrame, key: str, column: str) -> DataFrame:
    """``key, position, start, end, sentence``: a row a sentence."""

    @F.pandas_udf("array<struct<start long, end long>>")
    def spans(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"start": a, "end": z} for a, z in split_sentences(x or "")])

    got = df.select(key, column, F.posexplode(spans(column)).alias("position", "s"))
    return got.select(key, "position", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring(F.col(column), F.col("s.start").cast("int") + 1, (F.col("s.end") - F.col("s.start")).cast("int")).alias("sentence"))


_KEEP = ("CodeGroup", "Info", "AccordionGroup", "Accordion")
_ACCORDION = re.compile(r"<Accordion\s+title=['\"](.+?)['\"]\s*>(.*?)</Accordion>", re.S)
_BLOCK = re.compile(r"<([A-Za-z][A-Za-z0-9]*)[^>]*>(.*?)</\1>", re.S)


def mdx(text: str) -> str:
    """Markdown of an MDX text: titled accordions become headings, notes quotes, groups their content; any other element goes with its
    content, as do tags without a partner, and blank lines collapse."""

    def element(m: re.Match) -> str:
        name, inner = m.group(1), m.group(2).strip()
        if name not in _KEEP:
            return ""
        shape = {"Info": "\n\n> **Note:**\n>\n> {}\n", "Accordion": "{}"}.get(name, "\n\n{}\n")
        return shape.replace("{}", inner)

    text = _ACCORDION.sub(lambda m: f"\n\n### {m.group(1)}\n\n{m.group(2).strip()}\n", text)
    text = _BLOCK.sub(element, text)
    text = re.sub(r"<[A-Za-z][A-Za-z0-9]*[^>]*/>|</[A-Za-z][A-Za-z0-9]*>", "", text)
    return re.sub(r"\n\s*\n", "\n\n", text).strip()


_MARK = re.compile(r'\\.|["\x00-\x1f\x7f-\x9f]', re.S)


def repaired_json(text: str) -> str:
    """JSON with the control characters inside its strings escaped; all else, escaped characters too, stays as it is."""
    inside = False

    def turn(m: re.Match) -> str:
        nonlocal inside
        c = m.group(0)
        if c == '"':
            inside = not inside
            return c
        if len(c) > 1 or not inside:
            return c
        return {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c) or f"\\u{ord(c):04x}"

    return _MARK.sub(turn, text)


def _each(f):
    @F.pandas_udf("string")
    def turn(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else f(x))

    return turn


def mdx_to_md(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, _each(mdx)(column))


def repair_json(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, _each(repaired_json)(column))
