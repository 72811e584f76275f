"""Dates, arithmetic, boxes and value mappings as columns."""

from __future__ import annotations

from datetime import UTC, datetime
from itertools import chain
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: statuses and priorities by what trackers call them
STATUS = {
    "new": "NEW", "open": "OPEN", "in progress": "IN_PROGRESS", "resolved": "RESOLVED", "closed": "CLOSED", "cancelled": "CANCELLED", "canceled": "CANCELLED", "reopened": "REOPENED", "pending": "PENDING", "waiting": "WAITING",
    "blocked": "BLOCKED", "done": "DONE", "completed": "DONE", "to do": "NEW", "todo": "NEW", "in review": "QA", "review": "QA", "testing": "QA", "qa": "QA", "backlog": "NEW", "unstarted": "NEW", "started": "IN_PROGRESS", "planned": "NEW",
    "pending reminder": "PENDING", "pending close": "PENDING", "merged": "CLOSED",
}
PRIORITY = {
    "lowest": "LOWEST", "low": "LOW", "medium": "MEDIUM", "normal": "MEDIUM", "high": "HIGH", "highest": "HIGHEST", "critical": "CRITICAL", "blocker": "BLOCKER", "urgent": "HIGHEST", "trivial": "LOWEST", "minor": "LOW", "major": "HIGH",
    "none": "UNKNOWN", "no priority": "UNKNOWN", "0": "UNKNOWN", "p0": "UNKNOWN", "1 low": "LOW", "2 normal": "MEDIUM", "3 high": "HIGH", "4 urgent": "HIGHEST",
}


#: fixed values: item types, in the order in which parts of names are looked for
ITEM_TYPE = {
    "task": "TASK", "tasks": "TASK", "bug": "BUG", "bugs": "BUG", "defect": "BUG", "story": "STORY", "stories": "STORY", "user story": "STORY", "epic": "EPIC", "epics": "EPIC", "feature": "FEATURE", "features": "FEATURE",
    "subtask": "SUBTASK", "sub-task": "SUBTASK", "incident": "INCIDENT", "incidents": "INCIDENT", "improvement": "IMPROVEMENT", "improvements": "IMPROVEMENT", "enhancement": "IMPROVEMENT", "enhancements": "IMPROVEMENT",
    "question": "QUESTION", "questions": "QUESTION", "documentation": "DOCUMENTATION", "docs": "DOCUMENTATION", "doc": "DOCUMENTATION", "test": "TEST", "tests": "TEST", "testing": "TEST", "test case": "TEST", "testcase": "TEST",
}
DELIVERY = {f"{a}{gap}{b}": f"{a}_{b}".upper() for a, b in (("on", "track"), ("at", "risk"), ("off", "track"), ("high", "risk"), ("some", "risk")) for gap in (" ", "_", "")}
RELATION = {
    "blocks": "BLOCKS", "duplicates": "DUPLICATES", "duplicate": "DUPLICATES", "depends on": "DEPENDS_ON", "depends_on": "DEPENDS_ON", "dependson": "DEPENDS_ON", "clones": "CLONES", "implements": "IMPLEMENTS", "reviews": "REVIEWS",
    "causes": "CAUSES", "related": "RELATED", "relates to": "RELATED", "relates_to": "RELATED", "relatesto": "RELATED",
}
NUMBERED = ("HIGHEST", "HIGH", "MEDIUM", "LOW", "LOWEST")


def _table(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's value, underscores and hyphens read as spaces too; else the original. Empty texts have none."""
    m = _table(table)
    low = F.lower(F.trim(c))
    return F.when(c != "", F.coalesce(F.try_element_at(m, low), F.try_element_at(m, F.regexp_replace(low, "[_-]+", " ")), c))


def priority(c: Column) -> Column:
    """A priority's name, or its number with or without a ``p``: 1 is the highest, 5 and more the lowest, 0 unknown."""
    low = F.lower(F.trim(c))
    n = F.regexp_extract(low, "^p?([0-9]+)$", 1).try_cast("decimal(38,0)")
    by_number = F.when(n == 0, "UNKNOWN").when(n.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in NUMBERED]), F.least(n, F.lit(5)).cast("int")))
    return F.when(c != "", F.coalesce(F.try_element_at(_table(PRIORITY), low), by_number, c))


def item_type(c: Column) -> Column:
    """An item type's name, else that of the first table entry that the name holds or that holds the name, else the original."""
    low = F.lower(F.trim(c))
    part = F.coalesce(*[F.when(low.contains(k) | F.lit(k).contains(low), v) for k, v in ITEM_TYPE.items()])
    return F.when(c != "", F.coalesce(F.try_element_at(_table(ITEM_TYPE), low), part, c))


def relation(c: Column, custom: dict[str, str] | None = None) -> Column:
    return mapped(c, {**RELATION, **(custom or {})})


def epoch_ms(iso: Column) -> Column:
    """Milliseconds of an ISO time, whole seconds only; no zone means UTC."""
    return (F.unix_timestamp(F.try_to_timestamp(iso)) * 1000).cast("long")


def iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_offset(at: Column, zone: str) -> Column:
    """``+HH:MM`` of a zone at a UTC time."""
    minutes = F.round((F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)) / 60).cast("int")
    size = F.abs(minutes)
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad((size / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def excluded_dates(start: Column, end: Column, holidays: Column, saturdays: bool = True, sundays: bool = True) -> Column:
    """Weekend days and holidays from ``start`` to ``end``, inclusive, sorted and once each; null if the order is wrong."""
    days = F.sequence(start, F.greatest(start, end))
    off = [d for d, on in ((5, saturdays), (6, sundays)) if on]
    rest = F.filter(days, lambda d: F.weekday(d).isin(off)) if off else F.array().cast("array<date>")
    inside = F.filter(holidays, lambda d: d.between(start, end))
    return F.when(start <= end, F.array_sort(F.array_union(rest, inside)))


def exclusion_breakdown(start: Column, end: Column, holidays: Column, saturdays: bool = True, sundays: bool = True) -> Column:
    """How many days ``excluded_dates`` has of each kind: a struct; holidays count once."""
    days = F.sequence(start, F.greatest(start, end))
    inside = F.array_distinct(F.filter(holidays, lambda d: d.between(start, end)))
    n = lambda k, on: F.size(F.filter(days, lambda d: F.weekday(d) == k)) if on else F.lit(0)
    off = [k for k, on in ((5, saturdays), (6, sundays)) if on]
    on_weekends = F.size(F.filter(inside, lambda d: F.weekday(d).isin(off))) if off else F.lit(0)
    return F.when(start <= end, F.struct(
        n(5, saturdays).alias("saturdays"), n(6, sundays).alias("sundays"), F.size(inside).alias("holidays"), (F.size(inside) - on_weekends).alias("holidays_on_weekdays"),
        on_weekends.alias("holidays_on_weekends"), (F.date_diff(end, start) + 1).alias("total_days"),
    ))


def feed_time_ms(parts: Column) -> Column:
    """Milliseconds of a feed's UTC time given as year, month, day, hour, minute and second; null if that is no time."""
    t = F.array_join(F.transform(F.slice(parts, 1, 6), lambda x: F.format_string("%02d", x.cast("int"))), "-")
    return F.when(F.size(parts) >= 6, F.unix_millis(F.try_to_timestamp(t, F.lit("yyyy-MM-dd-HH-mm-ss"))))


def zone_line(zone: str | None, moment: datetime | None = None) -> str:
    """The line that tells a prompt the user's time zone; an unknown zone is named without an offset. One a request, so plain Python."""
    name = (zone or "").strip()
    if not name:
        return ""
    try:
        at = (moment or datetime.now(UTC)).astimezone(ZoneInfo(name)) if moment is None or moment.tzinfo else moment.replace(tzinfo=ZoneInfo(name))
    except (KeyError, ValueError, OSError):
        return f"**Time zone**: {name}"
    minutes = int(at.utcoffset().total_seconds() // 60)
    return f"**Time zone**: {name} ({at.tzname() or 'local'}, UTC{'+' if minutes >= 0 else '-'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d})"


def dates_in(c: Column, year: int | None = None) -> Column:
    """Dates named in a text: ISO, D/M/Y (M/D/Y where that is the only reading), ``Month D, YYYY`` and ``D Month YYYY``; sorted, once each."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    take = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    date = lambda x, f: F.to_date(F.try_to_timestamp(x, F.lit(f)))
    ways = [
        F.transform(take(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), lambda x: date(x, "yyyy-MM-dd")),
        F.transform(take(r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"), lambda x: F.coalesce(date(x, "d/M/yyyy"), date(x, "M/d/yyyy"))),
        F.transform(take(rf"\b{month} [0-9]{{1,2}}, [0-9]{{4}}\b"), lambda x: date(x, "MMMM d, yyyy")),
        F.transform(take(rf"\b[0-9]{{1,2}} {month} [0-9]{{4}}\b"), lambda x: date(x, "d MMMM yyyy")),
    ]
    got = F.array_sort(F.array_distinct(F.array_compact(F.concat(*ways))))
    return got if year is None else F.filter(got, lambda d: F.year(d) == year)


def calculate(op: str, a: Column, b: Column | None = None) -> Column:
    """Arithmetic by name; null where there is no result (division by 0, root of a negative number)."""
    #: fixed values: names of operations
    names = {"add": "+", "plus": "+", "sum": "+", "subtract": "-", "minus": "-", "multiply": "*", "times": "*", "divide": "/", "power": "^", "pow": "^", "sqrt": "r2", "square root": "r2", "cbrt": "r3", "cube root": "r3"}
    kind = names.get(op.strip().lower())
    if kind is None:
        raise ValueError(f"no operation {op!r}")
    if kind == "r2":
        return F.when(a >= 0, F.sqrt(a))
    if kind == "r3":
        return F.cbrt(a)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b != 0, a / b), "^": lambda: F.pow(a, b)}[kind]()


def corners(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Four points from the top left clockwise."""
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((left, top), (right, top), (right, bottom), (left, bottom))])


def normalised(points: Column, width: Column, height: Column, flip: bool = True) -> Column:
    """Points as shares of the page, by default with y counted from the other end; null for a page without size."""
    y = (lambda p: (height - p["y"]) / height) if flip else (lambda p: p["y"] / height)
    return F.when((width > 0) & (height > 0), F.transform(points, lambda p: F.struct((p["x"] / width).alias("x"), y(p).alias("y"))))


def denormalised(points: Column, width: Column, height: Column) -> Column:
    """Shares as points; y isn't turned back."""
    return F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y")))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` covers; 0 for an empty ``a``."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return F.when(area(a) > 0, w * h / area(a)).otherwise(0.0)


def needs_ocr(n_chars: Column, images: Column, words: Column, page_area: Column) -> Column:
    """Little text and more than two large images, or words on less than a hundredth of the page. ``images``: array of width and height;
    ``words``: array of boxes."""
    large = F.size(F.filter(images, lambda i: (i["width"] > 500) & (i["height"] > 500)))
    covered = F.aggregate(words, F.lit(0.0), lambda acc, x: acc + area(x))
    return ((n_chars < 100) & (large > 2)) | (F.when(page_area > 0, covered / page_area).otherwise(0.0) < 0.01)


def to_page_units(pixels: Column, dpi: Column) -> Column:
    return pixels * 72.0 / dpi


def may_merge(words: Column, kind: Column, next_kind: Column, least: int = 15) -> Column:
    """Whether a block goes together with the next one: both are text (kind 0), and it has fewer than ``least`` words."""
    return F.coalesce((kind == 0) & (next_kind == 0) & (words < least), F.lit(False))


def ranges(indices: Column) -> Column:
    """Inclusive ranges of an array's distinct numbers, in order: array of struct(start, end)."""
    one = F.array_sort(F.array_distinct(F.array_compact(indices)))

    def of(v):
        # a range starts where the number before is missing, and ends where the next one is
        starts = F.filter(v, lambda x, i: (i == 0) | (F.get(v, i - 1) != x - 1))
        ends = F.filter(v, lambda x, i: (i == F.size(v) - 1) | (F.get(v, i + 1) != x + 1))
        return F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), z.alias("end")))

    return F.transform(F.array(one), of)[0]


def child_ranges(children: Column) -> Column:
    """A list of children (``block_index``, ``block_group_index``, either may be null) as ranges of both."""
    pick = lambda name: ranges(F.transform(children, lambda x: x[name]))
    return F.when(children.isNotNull(), F.struct(pick("block_index").alias("block_ranges"), pick("block_group_index").alias("block_group_ranges")))
