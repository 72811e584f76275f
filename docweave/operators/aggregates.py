"""Aggregations: statistics pivots, summaries, facets, merges of chunk metadata and boxes, index ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_pivot(rows: DataFrame, type_col: str, status_col: str, count_col: str, statuses: list[str]) -> DataFrame:
    """``record_type, total`` and one column a status, zero-filled; the row of null type is the whole. Other statuses count
    towards totals only, null types towards the whole only."""
    sums = [F.coalesce(F.sum(F.when(F.col(status_col) == s, F.col(count_col))), F.lit(0)).cast("long").alias(s.lower()) for s in statuses]
    total = F.coalesce(F.sum(count_col), F.lit(0)).cast("long").alias("total")
    typed = rows.where(F.col(type_col).isNotNull()).groupBy(F.col(type_col).alias("record_type")).agg(total, *sums)
    whole = rows.agg(total, *sums).select(F.lit(None).cast("string").alias("record_type"), "total", *[s.lower() for s in statuses])
    return whole.unionByName(typed)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row of counts, a column a table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, parts).agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in tables])


def total_count(tables: list[DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")) for df in tables]
    return reduce(DataFrame.union, parts).agg(F.sum("n").cast("long").alias("n"))


def group_statistics(groups: DataFrame, name: str, members: str) -> DataFrame:
    size = F.size(F.coalesce(F.col(members), F.array().cast(dict(groups.dtypes)[members])))
    return groups.groupBy(name).agg(F.count("*").alias("n_groups"), F.sum(size).cast("long").alias("n_members"), F.avg(size).alias("avg_members"))


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """``facet, value, n`` of each column over all rows; give a page's rows for counts of that page."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("facet"), "value", "n") for c in columns]
    return reduce(DataFrame.union, parts)


def validation(nodes: DataFrame, key: str, has_record: Column, valid: Column) -> DataFrame:
    """Totals and whether all are valid; ``invalid_nodes`` lists those that aren't."""
    bad = ~(has_record & valid)
    return nodes.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(has_record.cast("long")), F.lit(0)).alias("with_record"),
        F.coalesce(F.sum((has_record & valid).cast("long")), F.lit(0)).alias("valid"),
        F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("invalid"),
        (F.coalesce(F.sum(bad.cast("long")), F.lit(0)) == 0).alias("success"),
    )


def invalid_nodes(nodes: DataFrame, key: str, has_record: Column, valid: Column) -> DataFrame:
    """The nodes that ``validation`` counts as invalid, and why; rows, as a list has no bound."""
    why = F.when(~F.coalesce(has_record, F.lit(False)), "no record").when(~F.coalesce(valid, F.lit(False)), "not valid")
    return nodes.select(key, why.alias("reason")).where("reason is not null")


def box_union(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The smallest box around each group's boxes (``x0, y0, x1, y1``) and its corners from the top left clockwise."""
    got = boxes.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return got.withColumn("corners", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


def index_ranges(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Inclusive ranges of the distinct indices of each group: ``start, end``."""
    one = df.select(*by, F.col(index).alias("_i")).where("_i is not null").distinct()
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*by).orderBy("_i"))
    return one.withColumn("_g", island).groupBy(*by, "_g").agg(F.min("_i").alias("start"), F.max("_i").alias("end")).drop("_g")


def merge_metadata(chunks: DataFrame, by: str, order: str, scalars: list[str], lists: list[str], best: list[str]) -> DataFrame:
    """One row a group. A scalar field gives ``<name>`` if all its non-null values are equal, else null and ``<name>_all``, its distinct values in
    order of first sight; lists give their ordered distinct union, ``best`` fields their maximum. Values are made distinct before they are gathered."""
    out = chunks.groupBy(by).agg(*[F.max(c).alias(c) for c in best]) if best else chunks.select(by).distinct()

    def distinct(rows: DataFrame, value: Column) -> DataFrame:
        one = rows.groupBy(by, value.alias("_v")).agg(F.min("_o").alias("_o")).where("_v is not null")
        return one.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"]).alias("_all"))

    for c in scalars:
        got = distinct(chunks.select(by, F.struct(F.col(order)).alias("_o"), c), F.col(c))
        got = got.select(F.col(by).alias("_by"), F.when(F.size("_all") == 1, F.col("_all")[0]).alias(c), F.when(F.size("_all") > 1, F.col("_all")).alias(f"{c}_all"))
        out = out.join(got, out[by].eqNullSafe(got["_by"]), "left").drop("_by")
    for c in lists:
        rows = chunks.select(by, order, F.posexplode(c).alias("_p", c)).select(by, F.struct(order, "_p").alias("_o"), c)
        got = distinct(rows, F.col(c)).select(F.col(by).alias("_by"), F.col("_all").alias(c))
        out = out.join(got, out[by].eqNullSafe(got["_by"]), "left").drop("_by")
    return out


def cache_statistics(lookups: DataFrame, hit: Column, expired: Column) -> DataFrame:
    n = F.count("*")
    hits = F.coalesce(F.sum(hit.cast("long")), F.lit(0))
    return lookups.agg(
        hits.alias("hits"), (n - hits).alias("misses"), F.coalesce(F.round(100.0 * hits / F.nullif(n, F.lit(0)), 2), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.sum(expired.cast("long")), F.lit(0)).alias("expired")
    )


def median_or(df: DataFrame, by: list[str], value: str, default: float) -> DataFrame:
    """The exact median of positive values; groups without any get ``default``."""
    return df.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col(value) > 0, F.col(value))), F.lit(default)).alias("median"))


def page_vote(pages: DataFrame, by: str, flag: str) -> DataFrame:
    """Whether at least half of a document's pages, rounded up, are flagged."""
    yes = F.sum(F.coalesce(F.col(flag), F.lit(False)).cast("long"))
    return pages.groupBy(by).agg(F.count("*").alias("pages"), yes.alias("flagged"), (yes >= F.ceil(F.count("*") * 0.5)).alias("vote"))


def top_values(df: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` first distinct values in order, a row each."""
    one = df.select(by, value).where(F.col(value).isNotNull()).distinct()
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(value))).where(F.col("rank") <= n)


def parallel_arrays(df: DataFrame, by: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """Groups with one array a column, all in the same order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(k) for k, c in columns.items()])))
    got = df.groupBy(*by).agg(rows.alias("_rows"))
    return got.select(*by, *[F.col("_rows").getField(k).alias(k) for k in columns])
