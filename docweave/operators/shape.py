"""Shaping of answers: citations and nested fields."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text as tx


def citations(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """``key, position, url, record_id, block_index`` of the Markdown links in order."""
    got = answers.select(key, F.posexplode(tx.link_targets(F.coalesce(F.col(answer), F.lit("")))).alias("position", "url"))
    return got.withColumn("record_id", tx.record_of(F.col("url"))).withColumn("block_index", tx.block_index(F.col("url")))


def join_citations(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """Citations with the block they mean: the one of equal ``url``, else that of equal record and index. ``blocks``: url, record_id, block_index,
    block_id, with urls and (record, index) pairs unique."""
    a = blocks.select(F.col("url").alias("_u"), F.col("block_id").alias("_by_url"))
    b = blocks.select(F.col("record_id").alias("_r"), F.col("block_index").alias("_i"), F.col("block_id").alias("_by_place"))
    got = found.join(a, found.url == F.col("_u"), "left").join(b, (found.record_id == F.col("_r")) & (found.block_index == F.col("_i")), "left")
    return got.select(*found.columns, F.coalesce("_by_url", "_by_place").alias("block_id"))


def unknown_citations(answers: DataFrame, key: str, answer: str, hits: DataFrame, records: DataFrame, refs: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """``key, target``: distinct citations that mean nothing known. A short reference is known if ``refs`` (``key, ref``) has it; an address
    if its record and block are a hit (``record_id, block_index``), a child row of one of the record's tables (``children``, the same columns), or a block within the record (``record_id, n_blocks``)."""
    one = answers.select(key, F.explode(tx.cited(F.coalesce(F.col(answer), F.lit("")))).alias("target")).distinct()
    short = one.where(F.col("target").rlike(r"^ref[0-9]+$"))
    if refs is not None:
        short = short.join(refs.select(key, F.col("ref").alias("target")), [key, "target"], "left_anti")
    full = one.where(~F.col("target").rlike(r"^ref[0-9]+$")).withColumn("record_id", tx.record_of(F.col("target"))).withColumn("block_index", tx.block_index(F.col("target")))
    places = hits.select("record_id", "block_index")
    if children is not None:
        places = places.union(children.select("record_id", "block_index"))
    full = full.join(places, ["record_id", "block_index"], "left_anti")
    r = records.select(F.col("record_id").alias("_r"), "n_blocks")
    full = full.join(r, (full.record_id == F.col("_r")) & (full.block_index >= 0) & (full.block_index < F.col("n_blocks")), "left_anti")
    return short.select(key, "target").union(full.select(key, "target"))


def flattened(hits: DataFrame, children: str, is_group: Column) -> DataFrame:
    """Hits with each table or list replaced by its child rows (an array of structs whose fields replace the hit's own); a group without children goes."""
    inner = [f.name for f in hits.schema[children].dataType.elementType.fields]
    own = [c for c in hits.columns if c != children]
    single = hits.where(~F.coalesce(is_group, F.lit(False))).select(*own)
    rows = hits.where(is_group).withColumn("_child", F.explode(children))
    return single.unionByName(rows.select(*[F.col(f"_child.{c}").alias(c) if c in inner else F.col(c) for c in own]))


def _matches(path: list[str], pattern: list[str]) -> bool:
    return len(path) == len(pattern) and all(fnmatchcase(a, b) for a, b in zip(path, pattern))


def _shape(column: Column, kind: T.DataType, path: list[str], drop: list[list[str]], keep: list[list[str]], held: bool) -> Column | None:
    if isinstance(kind, T.ArrayType):
        if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
            return column if held else None
        probe = _shape(F.lit(None), kind.elementType, path, drop, keep, held)
        return None if probe is None else F.transform(column, lambda x: _shape(x, kind.elementType, path, drop, keep, held))
    if not isinstance(kind, T.StructType):
        return column if held else None
    fields = []
    for f in kind.fields:
        here = [*path, f.name]
        if any(_matches(here, p) for p in drop):
            continue
        got = _shape(column[f.name] if path or isinstance(column, Column) else F.col(f.name), f.dataType, here, drop, keep, held or not keep or any(_matches(here, p) for p in keep))
        if got is not None:
            fields.append(got.alias(f.name))
    return F.when(column.isNotNull(), F.struct(*fields)) if fields else None


def project(df: DataFrame, remove: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Nested fields by path patterns (``a.b``, ``*.x``, ``a.*.b``). Removal wins; with ``keep`` only what matches, or lies below what matches,
    stays. Array levels don't count."""
    drop, hold = [p.split(".") for p in remove], [p.split(".") for p in keep]
    out = []
    for f in df.schema.fields:
        if any(_matches([f.name], p) for p in drop):
            continue
        got = _shape(F.col(f.name), f.dataType, [f.name], drop, hold, not hold or any(_matches([f.name], p) for p in hold))
        if got is not None:
            out.append(got.alias(f.name))
    return df.select(*out)
