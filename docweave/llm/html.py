"""Main text of web pages, by equivalence classes of tokens across the pages of a host.

Tokens of a page are its element paths and its text blocks, a block being told by its path, its text and how many equal ones came before. A
token's occurrence vector says on which of the host's pages it is. It is kept as an additive digest (sums of a hash of each
page's html, so that copies of a page make no difference), and vectors are compared without gathering them. Tokens of a host with equal vectors that hold two different
pages or more form a class. A class is valid if it has an element path: text that only recurs, as in versions of one article, has no element of its own.

A page takes the classes that it holds, widest first, and nests them into its template: the members must come in the class's order, and a class that
straddles members of a wider one is cut there, of which the parts that still have an element path stay. Text of nested classes is template text,
their elements may hold the main slot, and what lies between is the slots' text. The main slot is the deepest such element that has nearly all
text of the slots. A page's text is all of its ``article`` or ``main`` element, else of its main slot, else of its body, without elements that are menus,
adverts, forms and the like by their name, or by a class name that says nothing else. Nothing in the element or slot is dropped for being frequent, and a
class needs no share or number of the host's pages beyond two.

Cases: null html counts as empty and gives empty text; a page cut off in a tag or element is read up to there; repeated rows
count each; a null or odd url has an empty host; hosts with a single page, or copies of one, have no template. Other columns are
ignored. A host's template is one row: it holds no page's own text, so it grows with the host's layouts and not with its pages.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.scratch import materialise, tune

#: elements of running text, which are no slot of a page
LEAVES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 td th tr blockquote pre ul ol dl a b i em strong span font code small".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
ATTR = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
GONE = frozenset("head nav footer aside form script style noscript template svg iframe select button textarea dialog object canvas title menu".split())
BREAKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget related cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social comment comments disqus respond login signup search pagination pager toolbar skip masthead".split())
#: words that say nothing of an element beside its mark, as in share-buttons or left-sidebar
BESIDE = frozenset("top bottom left right middle main site page global primary secondary inner outer box bar block blocks list lists item items link links button buttons btn icon icons image container wrapper wrap area section sections zone slot unit holder group row col column panel content text title head header form small large mini sticky fixed floating mobile desktop social user reader readers post posts story stories article articles news blog more".split())
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _boring(name: str, attrs: str, inside: bool) -> bool:
    if name in GONE or (name == "header" and not inside):
        return True
    if name in ("html", "body", "article", "main") or not attrs:
        return name == "article" and bool(attrs) and _marked(attrs, frozenset(("comment", "comments")))
    return _marked(attrs, MARKS)


def _marked(attrs: str, marks: frozenset) -> bool:
    for k, a, b, c in ATTR.findall(attrs):
        value = a or b or c
        if k.lower() == "role" and value.lower().split(" ")[0] in ("banner", "contentinfo", "complementary", "dialog", "alert", "navigation", "search"):
            return True
        for name in value.split():
            words = {w.lower() for w in WORDS.findall(name) if len(w) > 1}
            if not marks.isdisjoint(words) and words <= MARKS | BESIDE:
                return True
    return False


def _is_main(name: str, attrs: str) -> bool:
    return name in ("article", "main") or any((a or b or c).lower() in ("main", "articlebody") for k, a, b, c in ATTR.findall(attrs) if k.lower() in ("role", "itemprop"))


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """The text blocks of a page in order: element path, text, whether in the main element, whether in a boring one."""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = []  # name, path, main, boring
    parts: list[str] = []
    here = ("", "", False, False)
    at = 0

    def flush():
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                out.append((here[1], text, here[2], here[3]))
            parts.clear()

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name == "br":
                parts.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if name in BREAKS or name in GONE or stack[k][3]:
                        flush()
                    del stack[k:]
                    here = stack[-1] if stack else ("", "", False, False)
                    break
            else:
                if name in BREAKS:
                    flush()
            continue
        attrs = m.group(3)
        if name == "br":
            parts.append(" ")
            continue
        if name in BREAKS or name in GONE:
            flush()
            if name in BREAKS:
                # an open paragraph ends where a block begins; a list item or cell where the next one does
                ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(name, ()) + ("p",)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ends:
                        del stack[k:]
                        here = stack[-1] if stack else ("", "", False, False)
                        break
                    if stack[k][0] in BREAKS:
                        break
        if name in VOID or attrs.endswith("/"):
            continue
        if name in RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = close.start() if close else n
            if close:
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
            continue
        main = here[2] or _is_main(name, attrs)
        boring = here[3] or _boring(name, attrs, here[2])
        if boring and not here[3]:
            flush()
        kind = next((f".{(a or b or c).split(' ')[0]}" for k, a, b, c in ATTR.findall(attrs) if k.lower() == "class" and (a or b or c)), "") if attrs else ""
        here = (name, f"{here[1]}/{name}{kind}", main, boring)
        stack.append(here)
    flush()
    return out


def _hash(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)), 7)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tokens(some: list[tuple[str, str, bool, bool]]) -> dict[int, tuple[int, str | None]]:
    """The tokens of a page's blocks: place on the page, and an element's path (None for text). Boring elements have none."""
    out: dict[int, tuple[int, str | None]] = {}
    paths: set[str] = set()
    again: dict[tuple[str, str], int] = {}
    for k, (path, text, _, boring) in enumerate(some):
        if boring:
            continue
        depth, at = path.count("/"), path
        while at and at not in paths:
            paths.add(at)
            out[_signed(_hash("path", at))] = (k << 8 | min(depth, 254), at)
            depth, at = depth - 1, at.rpartition("/")[0]
        n = again[path, text] = again.get((path, text), 0) + 1
        out[_signed(_hash("text", path, text, n))] = (k << 8 | 255, None)
    return out


def _tokens(batches):
    """Of each host in a batch every token's rows, vector digest, least and greatest page, and its place on the least one."""
    names = ["host", "token", "element", "rows", "low", "high", "least", "most", "place"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for b in batches:
        seen: dict[tuple[str, int], list] = {}
        for host, page in zip(*(c.to_pylist() for c in b.columns)):
            h = _hash(page or "")
            low, high, name = h & 0x7FFFFFFF, h >> 33, h >> 1
            for token, (place, path) in tokens(blocks(page or "")).items():
                row = seen.get((host, token))
                if row is None:
                    seen[host, token] = [path is not None, 1, low, high, name, name, place]
                else:
                    row[1] += 1
                    row[2] += low
                    row[3] += high
                    if name < row[4]:
                        row[4], row[6] = name, place
                    row[5] = max(row[5], name)
        rows = [(*k, *r) for k, r in seen.items()]
        cols = list(zip(*rows)) if rows else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def templates(pages: DataFrame) -> DataFrame:
    """``host, classes``: a host's valid classes, widest first, each as its tokens in their order."""
    t = pages.select("host", "html").mapInArrow(_tokens, "host string, token long, element boolean, rows long, low long, high long, least long, most long, place long")
    # a token's place on the least page that has it; tokens of a class have the same least page
    t = t.groupBy("host", "token").agg(
        F.max("element").alias("element"), *[F.sum(c).alias(c) for c in ("rows", "low", "high")], F.min(F.struct("least", "place")).alias("at"), F.max("most").alias("most")
    )
    vector = ["host", "rows", "low", "high"]
    classes = t.where("at.least <> most").groupBy(*vector).agg(F.max("element").alias("element"), F.collect_list(F.struct(F.col("at.place").alias("place"), "token")).alias("members"))
    classes = classes.where(F.col("element") & (F.size("members") > 1))
    own = F.struct((-F.col("rows")).alias("rows"), F.col("low"), F.transform(F.array_sort("members"), lambda m: m["token"]).alias("tokens"))
    return classes.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(own)), lambda c: c["tokens"]).alias("classes"))


def nested(page: dict[int, tuple[int, str | None]], classes: list[list[int]]) -> set[int]:
    """The tokens of the page that are its template."""
    found: set[int] = set()
    places: list[int] = []  # of the members so far, in order
    for members in classes:
        if any(m not in page for m in members):
            continue
        at = [page[m][0] for m in members]
        if any(x >= y for x, y in zip(at, at[1:])):
            continue
        parts: dict[int, list[int]] = {}
        for m, x in zip(members, at):
            parts.setdefault(bisect(places, x), []).append(m)
        for part in parts.values():
            if any(page[m][1] is not None for m in part):
                found.update(part)
        places = sorted(page[m][0] for m in found)
    return found


def _slot(some: list[tuple[str, str, bool]], elements: set[str]) -> str | None:
    """The deepest of the elements that holds nearly all text that isn't template text. If that is under a tenth of all text, the text
    itself repeats across pages (versions of one article), and all text counts."""
    own, every = {}, {}
    for path, text, fixed in some:
        steps = path.split("/")
        for k in range(1, len(steps) + 1):
            at = "/".join(steps[:k])
            every[at] = every.get(at, 0) + len(text)
            if not fixed:
                own[at] = own.get(at, 0) + len(text)
    if 10 * own.get("", 0) < every.get("", 0):
        own = every
    deep = [p for p, n in own.items() if p in elements and p.rsplit("/", 1)[-1].split(".")[0] not in LEAVES and n >= 0.8 * own[""]]
    return max(deep, key=lambda p: p.count("/"), default=None)


def main_text(page: str, classes: list[list[int]] | None = None) -> str:
    """The page's main text, blocks joined by an empty line. Nothing in the main element or slot is dropped for being frequent."""
    every = blocks(page)
    if any(main for _, _, main, _ in every):
        return "\n\n".join(t for _, t, main, boring in every if main and not boring)
    known = tokens(every)
    template = nested(known, classes or [])
    elements = {known[m][1] for m in template} - {None}
    fixed = {known[m][0] >> 8 for m in template if known[m][1] is None}
    some = [(p, t, k in fixed) for k, (p, t, _, boring) in enumerate(every) if not boring]
    slot = _slot(some, elements) if elements else None
    if slot:
        some = [x for x in some if x[0] == slot or x[0].startswith(slot + "/")]
        free = [k for k, x in enumerate(some) if not x[2]]
        # a body is no slot of its own: what lies around its first and last text of a slot is template
        if slot.rsplit("/", 1)[-1].split(".")[0] in ("html", "body") and 10 * sum(len(some[k][1]) for k in free) >= sum(len(t) for _, t, _ in some):
            some = some[free[0] : free[-1] + 1]
    return "\n\n".join(t for _, t, _ in some)


def _extract(batches):
    known: dict[str, list] = {}
    for b in batches:
        texts = []
        for k, host in enumerate(b.column(2).to_pylist()):
            if host not in known:
                if len(known) > 512:
                    known.clear()
                known[host] = b.column(4)[k].as_py() or []
            texts.append(main_text(b.column(3)[k].as_py() or "", known[host]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    tune(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    known = materialise(templates(pages), "templates").withColumnRenamed("host", "_host")
    # a small table of hosts is broadcast by its measured size, a large one is joined with skew split
    rows = pages.join(known, pages.host == known._host, "left").select("page_id", "url", "host", "html", "classes")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
