"""Ordered operators: ranks, first ones, suffixes, running budgets, last ones, batches. Every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank", k: int | None = None) -> DataFrame:
    got = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return got if k is None else got.where(F.col(name) <= k)


def first_of(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group. Ranks are cut before the shuffle, so a large group moves few rows."""
    return ranked(df, by, *order, name="_rank", k=1).drop("_rank")


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return ranked(df, [by], F.desc(order), name="_rank", k=n).drop("_rank")


def first_seen_numbers(df: DataFrame, by: str, key: str, position: str) -> DataFrame:
    """Numbers from 1 in order of each key's first position in its group."""
    first = df.groupBy(by, key).agg(F.min(position).alias("_at"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("_at", key))).select(by, key, F.col("_at").alias("first_at"), "number")


def suffix_repeats(df: DataFrame, by: list[str], name: str, position: str, start: int = 2) -> DataFrame:
    """``unique_name``: the first of equal names stays, later ones get ``_start, _start+1`` and so on."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(position))
    return df.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), F.col("_n") + (start - 2)))).drop("_n")


def suffix_collisions(df: DataFrame, by: list[str], name: str, position: str) -> DataFrame:
    """``unique_name``: names that occur once stay, all of the others get ``_1, _2`` and so on."""
    w = Window.partitionBy(*by, name)
    got = df.withColumn("_n", F.row_number().over(w.orderBy(position))).withColumn("_all", F.count("*").over(w))
    return got.withColumn("unique_name", F.when(F.col("_all") == 1, F.col(name)).otherwise(F.concat(name, F.lit("_"), F.col("_n")))).drop("_n", "_all")


def running_gate(df: DataFrame, by: list[str], order: str, amount: str, limit: int) -> DataFrame:
    """``running`` total up to and with each row, and whether it is still within ``limit``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("running", F.sum(amount).over(w)).withColumn("within", F.col("running") <= limit)


def token_budget(df: DataFrame, by: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Rows up to the first whose running total exceeds the budget; what follows that row is cut too."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = df.withColumn("running", F.sum(tokens).over(w)).withColumn("_over", F.max(F.col("running") > budget).over(w))
    return got.where(~F.col("_over")).drop("_over")


def prepared_content(blocks: DataFrame, by: str, order: str, kind: str, content: str, tokens: str, budget: int, images: int = 50) -> DataFrame:
    """The blocks that go to a model: text and table rows with content up to the first that would exceed the budget, and the first ``images`` images with content before that
    place. Only texts and rows use up tokens; other kinds are left out."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = blocks.where(F.col(kind).isin("text", "table_row", "image") & F.col(content).isNotNull() & (F.col(content) != ""))
    counted = F.when(F.col(kind) != "image", F.col(tokens)).otherwise(0)
    # sums only grow, so all after the first overflow exceed the budget too, images included
    got = some.withColumn("running", F.sum(counted).over(w)).withColumn("_image", F.sum((F.col(kind) == "image").cast("int")).over(w))
    return got.where((F.col("running") <= budget) & ((F.col(kind) != "image") | (F.col("_image") <= images))).drop("_image")


def fullest_rows(df: DataFrame, by: str, index: str, empty: str, n: int = 10) -> DataFrame:
    """The ``n`` rows of fewest empty values, ties to the smaller index, with their ``place`` (from 1) in the original order."""
    best = ranked(df, [by], F.col(empty), F.col(index), name="_rank", k=n).drop("_rank")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(index)))


def fixed_batches(df: DataFrame, by: str, order: str, size: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("batch", F.floor((n - 1) / size).cast("long"))


def greedy_batches(df: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """``by, order, batch``: a batch is closed when the next item would take it beyond ``most``; a larger item is a batch of its own.

    One group (a conversation) is folded in order, which no plain running sum can do.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))

    def step(acc, x):
        full = (acc["held"] > 0) & (acc["held"] + x["s"] > most)
        batch = F.when(full, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(full, x["s"]).otherwise(acc["held"] + x["s"]).alias("held"), F.concat(acc["rows"], F.array(F.struct(x["o"].alias("o"), batch.alias("batch")))).alias("rows"))

    kind = dict(df.dtypes)[order]
    zero = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).cast("long").alias("held"), F.array().cast(f"array<struct<o:{kind},batch:bigint>>").alias("rows"))
    got = df.groupBy(by).agg(items.alias("_items")).select(by, F.explode(F.aggregate("_items", zero, step, lambda a: a["rows"])).alias("r"))
    return got.select(by, F.col("r.o").alias(order), F.col("r.batch").alias("batch"))


def gap_runs(df: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """How many runs of true each group has."""
    before = F.lag(flag, 1, False).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_rise", F.col(flag) & ~F.coalesce(before, F.lit(False))).groupBy(by).agg(F.sum(F.col("_rise").cast("long")).alias("runs"))
