"""Sorting and pages. Sorts end in a key, so that pages neither repeat nor lose rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 200
#: fixed values: sort fields of browse listings
SORTS = {"name": "name", "createdAt": "created_at", "updatedAt": "updated_at", "size": "size", "type": "type"}


#: fixed values: sort fields of record listings, and the most rows of their pages
LISTED, LISTED_MOST = {"createdAtTimestamp": "created_at", "updatedAtTimestamp": "updated_at", "recordName": "record_name", "recordType": "record_type", "origin": "origin", "indexingStatus": "status"}, 100


def order(df: DataFrame, sort_by: str, direction: str, key: str, fields: dict[str, str] | None = None, fallback: str = "name") -> list[Column]:
    """An unknown field sorts by ``fallback``, any direction but ``asc`` is descending."""
    fields = fields or SORTS
    c = F.col(fields.get(sort_by, fields[fallback]))
    return [c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_last(), F.col(key)]


def page(df: DataFrame, by: list[Column], number: int = 1, limit: int = 50, most: int = MOST) -> DataFrame:
    """The rows of one page. Spark keeps only the best ``number * limit`` rows of each task."""
    number, limit = max(1, number), min(max(1, limit), most)
    return df.orderBy(*by).offset((number - 1) * limit).limit(limit)


@dataclass(frozen=True)
class PageInfo:
    page: int
    limit: int
    total: int
    pages: int
    has_next: bool
    has_prev: bool

    @staticmethod
    def of(total: int, number: int, limit: int, most: int = MOST) -> PageInfo:
        number, limit = max(1, number), min(max(1, limit), most)
        pages = math.ceil(total / limit)
        return PageInfo(number, limit, total, pages, number < pages, number > 1)


def page_info(df: DataFrame, number: int, limit: int, most: int = MOST) -> DataFrame:
    """The same as one row, without an action on the driver."""
    number, limit = max(1, number), min(max(1, limit), most)
    got = df.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / limit).cast("long"))
    return got.select(F.lit(number).cast("long").alias("page"), F.lit(limit).cast("long").alias("page_limit"), "total", "pages", (F.lit(number) < F.col("pages")).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def best_first(df: DataFrame, score: str, key: str, k: int | None = None) -> DataFrame:
    """By score, best first; a null score counts as 0."""
    got = df.orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), F.col(key))
    return got if k is None else got.limit(k)


def recent(df: DataFrame, time: str, key: str, cap: int = 100) -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_last(), F.col(key)).limit(cap)


def adaptive_limit(sources: int, cap: int = 4, single: int = 50, shared: int = 100) -> int:
    """How many hits to ask each source for."""
    return single if sources <= 1 else shared // min(sources, cap)


def catalog_page(df: DataFrame, internal: str, columns: list[str], display: str, key: str, term: str | None, number: int, limit: int) -> DataFrame:
    """A page of what isn't internal and has the term in any of the columns, by display name. A limit of 0 or less is one page of all."""
    got = df.where(~F.coalesce(F.col(internal), F.lit(False)))
    if term:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
        got = got.where(hit)
    by = [F.lower(F.col(display)), F.col(key)]
    return got.orderBy(*by) if limit <= 0 else got.orderBy(*by).offset((max(1, number) - 1) * limit).limit(limit)


def sorted_by(df: DataFrame, *keys: tuple[str, str]) -> DataFrame:
    """By several columns, each ``asc`` or ``desc``; nulls last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys])


def in_document_order(hits: DataFrame, document: str = "virtual_id", index: str = "block_index") -> DataFrame:
    """Hits as they stand in their documents; a hit without an index comes first."""
    return hits.orderBy(F.col(document), F.col(index).asc_nulls_first())


def record_listing(df: DataFrame, key: str, sort_by: str = "createdAtTimestamp", direction: str = "desc", number: int = 1, limit: int = 20) -> DataFrame:
    """A page of a record listing. Unlike a browse page it refuses what it doesn't know."""
    if sort_by not in LISTED or direction not in ("asc", "desc") or number < 1 or not 1 <= limit <= LISTED_MOST:
        raise ValueError(f"no listing by {sort_by!r} {direction!r}, page {number} of {limit}")
    return page(df, order(df, sort_by, direction, key, LISTED, sort_by), number, limit, LISTED_MOST)


def catalog_totals(df: DataFrame, internal: str, columns: list[str], display: str, key: str, term: str | None, limit: int) -> DataFrame:
    """``total, pages`` of the catalog that ``catalog_page`` pages; without a limit it is one page."""
    every = catalog_page(df, internal, columns, display, key, term, 1, 0)
    got = every.agg(F.count("*").alias("total"))
    return got.withColumn("pages", F.ceil(F.col("total") / limit).cast("long") if limit > 0 else F.lit(1).cast("long"))
