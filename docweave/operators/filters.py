"""Filters: boolean trees, typed filters, listing filters and scope rules, all compiled to columns that Catalyst can push down."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: fixed values: operators by filter type
OPERATORS = {
    "string": ("is", "is_not", "is_empty", "is_not_empty", "contains", "does_not_contain"),
    "boolean": ("is", "is_not"),
    "datetime": ("last_7_days", "last_14_days", "last_30_days", "last_90_days", "last_180_days", "last_365_days", "is_after", "is_before", "is_between"),
    "list": ("in", "not_in"),
    "multiselect": ("in", "not_in"),
    "number": ("is_between", "greater_than_or_equal", "greater_than", "equal", "less_than", "less_than_or_equal"),
}
MANUAL = "enable_manual_sync"


class FilterError(ValueError):
    """A filter that can't be compiled."""


def conditions(fields: Mapping[str, Any], prefix: str = "") -> list[Column]:
    """One column a field: a list matches any member, a scalar is equality. Null, blank and empty values, and null members,
    are dropped."""
    out = []
    for name, value in fields.items():
        column = F.col(prefix + name)
        if isinstance(value, (list, tuple, set, frozenset)):
            members = [v for v in value if v is not None and not (isinstance(v, str) and not v.strip())]
            if members:
                out.append(column.isin(members))
        elif value is not None and not (isinstance(value, str) and not value.strip()):
            out.append(column == value)
    return out


def tree(
    must: Mapping[str, Any] | None = None,
    should: Mapping[str, Any] | None = None,
    must_not: Mapping[str, Any] | None = None,
    min_should_match: int | None = None,
    mode: str = "must",
    prefix: str = "",
    **more: Any,
) -> Column:
    """AND, OR and NOT groups; ``more`` joins the group that ``mode`` names. No condition at all matches nothing. A null
    field counts as not equal."""
    groups = {"must": dict(must or {}), "should": dict(should or {}), "must_not": dict(must_not or {})}
    if mode not in groups:
        raise FilterError(f"mode {mode!r} is none of {', '.join(groups)}")
    groups[mode].update(more)
    found = {k: [F.coalesce(c, F.lit(False)) for c in conditions(v, prefix)] for k, v in groups.items()}
    parts = list(found["must"])
    if found["should"]:
        if min_should_match is None or min_should_match <= 1:
            parts.append(reduce(or_, found["should"]))
        else:
            parts.append(sum((c.cast("int") for c in found["should"]), F.lit(0)) >= min_should_match)
    parts += [~c for c in found["must_not"]]
    return reduce(and_, parts) if parts else F.lit(False)


def equals(fields: Mapping[str, Any]) -> Column:
    """All fields equal; a null value asks for null."""
    return reduce(and_, [F.col(k).isNull() if v is None else F.col(k) == v for k, v in fields.items()], F.lit(True))


def nodes_by(df: DataFrame, fields: Mapping[str, Any], columns: Iterable[str] | None = None) -> DataFrame:
    got = df.where(equals(fields))
    return got.select(*columns) if columns else got


def field_in(df: DataFrame, field: str, values: Iterable[Any] | DataFrame, columns: Iterable[str] | None = None, inline: int = 1000) -> DataFrame:
    """Rows whose field is among the values: a literal list up to ``inline`` values, else a semi-join whose strategy Spark picks by
    size. A DataFrame of values has them in its first column."""
    if not isinstance(values, DataFrame):
        values = list(dict.fromkeys(values))
        if len(values) <= inline:
            got = df.where(F.col(field).isin(values)) if values else df.where(F.lit(False))
            return got.select(*columns) if columns else got
        values = df.sparkSession.createDataFrame([(v,) for v in values], ["v"])
    keys = values.select(F.col(values.columns[0]).alias("_v"))
    got = df.join(keys, df[field] == F.col("_v"), "left_semi")
    return got.select(*columns) if columns else got


@dataclass(frozen=True)
class Filter:
    """A typed filter. Options given as ``{id, label}`` count as their id."""

    key: str
    type: str
    operator: str
    value: Any = None

    @staticmethod
    def make(key: str, type: str, operator: str, value: Any = None) -> Filter:
        operator = str(operator).strip().lower()
        if not str(key or "").strip():
            raise FilterError("a filter needs a key")
        if type not in OPERATORS:
            raise FilterError(f"no filter type {type!r}")
        if operator == "equals":  # the former name
            operator = {"list": "in", "multiselect": "in", "number": "equal"}.get(type, "is")
        if operator not in OPERATORS[type]:
            raise FilterError(f"{type} filters have no operator {operator!r}")
        if type in ("list", "multiselect"):
            if not isinstance(value, (list, tuple)):
                raise FilterError(f"{key}: a list is needed")
            value = tuple(v["id"] if isinstance(v, Mapping) else v for v in value)
        elif type == "boolean" and not isinstance(value, bool):
            raise FilterError(f"{key}: true or false is needed")
        elif type == "string" and value is not None and not isinstance(value, str):
            raise FilterError(f"{key}: a text is needed")
        elif type in ("number", "datetime") and not operator.startswith("last_"):
            pair = operator == "is_between" or type == "datetime"
            if pair and isinstance(value, Mapping):
                value = (value.get("start"), value.get("end"))
            if pair and isinstance(value, (list, tuple)):
                if len(value) != 2 or (None not in value and value[0] > value[1]):
                    raise FilterError(f"{key}: start and end are needed, in order")
                value = tuple(value)
            elif isinstance(value, bool) or not isinstance(value, (int, float)):
                raise FilterError(f"{key}: a number is needed")
        return Filter(key, type, operator, value)

    def column(self, column: Column | None = None, now_ms: int = 0) -> Column:
        """The predicate; ``now_ms`` is what relative windows end at, inclusive."""
        c, v, op = F.col(self.key) if column is None else column, self.value, self.operator
        if self.type == "string":
            return {
                "is": lambda: c == v,
                "is_not": lambda: c != v,
                "is_empty": lambda: c.isNull() | (c == ""),
                "is_not_empty": lambda: c.isNotNull() & (c != ""),
                "contains": lambda: c.contains(v),
                "does_not_contain": lambda: ~c.contains(v),
            }[op]()
        if self.type == "boolean":
            return c == v if op == "is" else c != v
        if self.type in ("list", "multiselect"):
            return c.isin(list(v)) if op == "in" else ~c.isin(list(v))
        if op.startswith("last_"):
            return c.between(now_ms - int(op.split("_")[1]) * DAY_MS, now_ms)
        if self.type == "datetime" and not isinstance(v, tuple):
            v = (v, None) if op == "is_after" else (None, v)
        if op == "is_between":
            return between(c, *v)
        if self.type == "datetime":
            return c > v[0] if op == "is_after" else c < (v[1] if v[1] is not None else v[0])
        return {"greater_than_or_equal": c >= v, "greater_than": c > v, "equal": c == v, "less_than": c < v, "less_than_or_equal": c <= v}[op]


def between(c: Column, low: Any, high: Any) -> Column:
    """An inclusive range, open where a bound is null."""
    return (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high)


def from_config(config: Mapping[str, Any]) -> list[Filter]:
    """Filters of ``{key: {type, operator, value}}``; malformed entries are left out."""
    out = []
    for key, entry in (config or {}).items():
        try:
            out.append(Filter.make(key, entry["type"], entry["operator"], entry.get("value")))
        except (FilterError, KeyError, TypeError, AttributeError):
            continue
    return out


def matches(filters: Iterable[Filter], now_ms: int = 0) -> Column:
    return reduce(and_, [f.column(now_ms=now_ms) for f in filters], F.lit(True))


def is_enabled(flags: Mapping[str, bool], key: str, default: bool = True) -> bool:
    """With manual sync on, every other key is off."""
    return False if flags.get(MANUAL) and key != MANUAL else bool(flags.get(key, default))


def enabled_column(flag: Column, manual: Column) -> Column:
    return F.when(F.coalesce(manual, F.lit(False)), False).otherwise(F.coalesce(flag, F.lit(True)))


def parse_range(text: str | None, most: int | None = None) -> tuple[int | None, int | None]:
    """Bounds of ``gte:N,lte:M``; other keys are ignored."""
    bounds: dict[str, int] = {}
    for part in (text or "").split(","):
        key, _, number = part.strip().partition(":")
        if key in ("gte", "lte"):
            try:
                bounds[key] = int(number)
            except ValueError:
                raise FilterError(f"{part!r} is no bound") from None
            if bounds[key] < 0 or (most is not None and bounds[key] > most):
                raise FilterError(f"{part!r} is out of range")
    low, high = bounds.get("gte"), bounds.get("lte")
    if low is not None and high is not None and low > high:
        raise FilterError("the range is upside down")
    return low, high


def known_values(values: Iterable[str] | None, valid: Iterable[str]) -> list[str] | None:
    """The values that exist; none left means no filter."""
    valid = set(valid)
    return [v for v in values or () if v in valid] or None


def strings(value: Any) -> list[str] | None:
    """A list of non-blank strings, or null."""
    items = [value] if isinstance(value, str) else list(value or ())
    return [s.strip() for s in items if isinstance(s, str) and s.strip()] or None


def scope(requested: Iterable[str] | None, allowed: Iterable[str]) -> list[str]:
    """Requested ids that are allowed; if none is, everything allowed."""
    allowed = list(allowed)
    wanted = set(requested or ())
    return [a for a in allowed if a in wanted] or allowed


def scope_column(requested: Column, allowed: Column) -> Column:
    both = F.array_intersect(allowed, requested)
    return F.when(F.coalesce(F.size(both), F.lit(0)) > 0, both).otherwise(allowed)


def has_text(columns: Iterable[str], term: str) -> Column:
    """Case-insensitive substring of any of the columns; a null column doesn't have it."""
    return reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False)) for c in columns])


def search(df: DataFrame, term: str, columns: Iterable[str], tags: str | None = None, any_tag: Iterable[str] | None = None, **fields: Any) -> DataFrame:
    """Keyword search: the term in any of the columns or equal to a tag; further, any of the tags and equal fields."""
    hit = has_text(columns, term)
    if tags:
        hit = hit | F.coalesce(F.array_contains(tags, term), F.lit(False))
    if tags and any_tag:
        hit = hit & F.coalesce(F.arrays_overlap(F.col(tags), F.array(*[F.lit(t) for t in any_tag])), F.lit(False))
    return df.where(hit & equals(fields))


def search_tools(df: DataFrame, query: str | None = None, category: str | None = None, tags: Iterable[str] = (), essential_only: bool = False) -> DataFrame:
    """Tools that are essential (if asked), of the category, with any of the tags, and with the query in their name or description, whatever its case."""
    got = df.where(F.coalesce(F.col("essential"), F.lit(False))) if essential_only else df
    if category:
        got = got.where(F.col("category") == category)
    if tags := list(tags):
        got = got.where(F.coalesce(F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in tags])), F.lit(False)))
    return got.where(has_text(["name", "description"], query)) if query else got


def has_tokens(column: str, query: str) -> Column:
    """A text index's match: any word of the query is a word of the text, whatever its case."""
    words = [w for w in re.findall(r"[^\W_]+", query.lower())]
    own = F.regexp_extract_all(F.lower(F.col(column)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    return F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(w) for w in words])), F.lit(False)) if words else F.lit(False)


LISTING = {"permissions", "source", "dates", "q", "node_types", "record_types", "origins", "connector_ids", "statuses", "created", "updated", "size", "group_ids", "only_containers"}


def listing(df: DataFrame, names: Mapping[str, str], strict: bool = False, **wanted: Any) -> tuple[DataFrame, bool]:
    """Listing filters over the columns that ``names`` gives; returns the rows, and whether this is a search (any filter at all)
    and no plain browse. ``strict`` rejects unknown parameters, else they are ignored."""
    if strict and (odd := set(wanted) - LISTING):
        raise FilterError(f"unknown parameters: {', '.join(sorted(odd))}")
    parts = []
    for key, value in wanted.items():
        if key == "source" and value not in ("all", "local", "connector"):
            raise FilterError(f"no source {value!r}")
        if key not in LISTING or value in (None, [], "", "all", (None, None)) or key not in names:
            continue
        c = F.col(names[key])
        if key == "q":
            if strict and len(value) > 1000:
                raise FilterError("the search text is too long")
            parts.append(F.coalesce(F.lower(c).contains(value.lower()), F.lit(False)))
        elif key == "source":
            # local records are uploaded, the others come from connectors
            parts.append(c == "UPLOAD" if value == "local" else c == "CONNECTOR")
        elif key in ("created", "updated", "size", "dates"):
            parts.append(between(c, *value))
        elif key == "only_containers":
            parts.append(c if value else F.lit(True))
        else:
            parts.append(c.isin(list(value)))
    return (df.where(reduce(and_, parts)) if parts else df), bool(parts)


def complete(df: DataFrame, content: str, required: Iterable[str]) -> DataFrame:
    """Rows with content and all required fields."""
    return df.where(F.col(content).isNotNull() & (F.col(content) != "")).dropna(subset=list(required))


def needs_update(there: str, here: str) -> Column:
    """A value on one side that is null or empty on the other."""
    return F.col(there).isNotNull() & (F.col(here).isNull() | (F.col(here) == ""))


def id_parts(identifier: Column) -> tuple[Column, Column]:
    """Collection and key of ``collection/key``."""
    return F.split_part(identifier, F.lit("/"), F.lit(1)), F.split_part(identifier, F.lit("/"), F.lit(2))


def own_id(df: DataFrame) -> Column:
    """A node's identity: ``id``, else ``_key``, else the tail of ``_id``."""
    have = [c for c in ("id", "_key") if c in df.columns]
    tail = [F.nullif(F.split_part(F.col("_id"), F.lit("/"), F.lit(2)), F.lit(""))] if "_id" in df.columns else []
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in have], *tail)


def knowledge_sources(df: DataFrame) -> DataFrame:
    """``label, is_collection, type_key, connector_id, collection_ids`` of an agent's knowledge (``name, type, connector_id, filters``, a JSON text): collections
    by their type, else connectors by their id; what is neither is left out."""
    kind = F.trim(F.coalesce(F.col("type"), F.lit("")))
    collection, connector = F.upper(kind) == "KB", F.nullif(F.trim(F.coalesce(F.col("connector_id"), F.lit(""))), F.lit(""))
    groups = F.filter(F.coalesce(F.from_json("filters", "recordGroups array<string>")["recordGroups"], F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    type_key = F.when(~collection, F.lower(F.split_part(kind, F.lit(" "), F.lit(1))))
    label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.when(collection, "Knowledge Base").otherwise(F.coalesce(F.nullif(F.initcap(type_key), F.lit("")), F.lit("App Connector"))))
    return df.where(collection | connector.isNotNull()).select(
        label.alias("label"), collection.alias("is_collection"), type_key.alias("type_key"), F.when(~collection, connector).alias("connector_id"), F.when(collection, groups).alias("collection_ids")
    )


def split_sources(df: DataFrame, type_col: str, filters_json: str) -> DataFrame:
    """Knowledge sources told apart: ``is_collection``, and the record groups in their JSON filters."""
    groups = F.from_json(F.col(filters_json), "recordGroups array<string>")["recordGroups"]
    is_collection = F.coalesce(F.upper(F.col(type_col)) == "KB", F.lit(False)) | (F.coalesce(F.size(groups), F.lit(0)) > 0)
    return df.withColumn("is_collection", is_collection).withColumn("record_groups", F.coalesce(groups, F.array().cast("array<string>")))
