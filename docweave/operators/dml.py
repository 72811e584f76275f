"""Changes as new tables: upserts, overwrite modes, deletes, payload updates, validation, taxonomy, versions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STRATEGIES = ("merge", "replace", "keep")
MODES = ("replace", "update", "ignore", "conflict")


def _both(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    a = old.select(F.struct(*old.columns).alias("_old"), *[F.col(k).alias(f"_o_{k}") for k in keys])
    b = new.select(F.struct(*new.columns).alias("_new"), *[F.col(k).alias(f"_n_{k}") for k in keys])
    on = reduce(lambda x, y: x & y, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys])
    return a.join(b, on, "full_outer")


def _field(df: DataFrame, side: str, name: str) -> Column:
    return F.col(f"{side}.{name}") if name in df.columns else F.lit(None)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], strategy: str = "merge") -> DataFrame:
    """``merge`` (new values that aren't null win; a partial update, which is also what stores do that call it replace with an
    update statement), ``replace`` (the new row as it is), ``keep`` (the old row). Keys are unique on both sides; columns are the
    union of both."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is none of {', '.join(STRATEGIES)}")
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    out = []
    for c in columns:
        o, n = _field(old, "_old", c), _field(new, "_new", c)
        if c in keys or strategy == "merge":
            v = F.coalesce(n, o)
        elif strategy == "replace":
            v = F.when(F.col("_new").isNotNull(), n).otherwise(o)
        else:
            v = F.when(F.col("_old").isNotNull(), o).otherwise(n)
        out.append(v.alias(c))
    return _both(old, new, keys).select(*out)


def insert(old: DataFrame, new: DataFrame, keys: list[str], mode: str = "conflict") -> tuple[DataFrame, DataFrame]:
    """The table after an insert, and one row of counts: created, updated, ignored, errors. ``conflict`` counts existing keys as
    errors and leaves them as they are."""
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {', '.join(MODES)}")
    table = upsert(old, new, keys, {"replace": "replace", "update": "merge"}.get(mode, "keep"))
    there = _both(old, new, keys).where(F.col("_new").isNotNull()).select(F.col("_old").isNotNull().alias("there"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    hit = F.col("there")
    counts = there.agg(
        n(~hit).alias("created"),
        (n(hit) if mode in ("replace", "update") else F.lit(0).cast("long")).alias("updated"),
        (n(hit) if mode == "ignore" else F.lit(0).cast("long")).alias("ignored"),
        (n(hit) if mode == "conflict" else F.lit(0).cast("long")).alias("errors"),
    )
    return table, counts


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns aren't in ``keys``; for edges give both ends, or the relation's type too."""
    return table.join(keys, keys.columns, "left_anti")


def delete_where(table: DataFrame, predicate: Column) -> DataFrame:
    return table.where(~F.coalesce(predicate, F.lit(False)))


def overwrite(table: DataFrame, predicate: Column, values: dict[str, Column]) -> DataFrame:
    """Payload columns set on the rows that match."""
    hit = F.coalesce(predicate, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def validate(df: DataFrame, rules: dict[str, Column], required: list[str] = (), partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``violations``. A rule holds where it is true or its column is null; required
    columns are asked for unless the row is a partial update."""
    marks = [F.when(~F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()]
    if not partial:
        marks += [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in required]
    found = df.withColumn("violations", F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))
    return found.where(F.size("violations") == 0).drop("violations"), found.where(F.size("violations") > 0)


def taxonomy(nodes: DataFrame, edges: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category nodes and edges after get-or-create. ``named`` (record, names): the names of levels 1 to n; a level counts only if those
    above it are named. ``nodes``: level, name. ``edges``: src, dst, where a node's key is ``level:name`` and a record its own."""
    rows = named.select("record", F.posexplode("names").alias("pos", "name")).where("name is not null and name <> ''")
    full = named.select("record", F.aggregate("names", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(
        (a["n"] + F.when(a["on"] & x.isNotNull() & (x != ""), 1).otherwise(0)).alias("n"), (a["on"] & x.isNotNull() & (x != "")).alias("on")))["n"].alias("depth"))
    rows = rows.join(full, "record").where("pos < depth").select("record", (F.col("pos") + 1).cast("long").alias("level"), "name")
    fresh = rows.select("level", "name").distinct().join(nodes, ["level", "name"], "left_anti")
    key = F.concat_ws(":", F.col("level").cast("string"), F.col("name"))
    to_record = rows.select(F.col("record").cast("string").alias("src"), key.alias("dst"))
    up = rows.select("record", F.col("level").alias("l"), F.col("name").alias("parent"))
    nest = rows.join(up.withColumn("level", F.col("l") + 1), ["record", "level"]).select(key.alias("src"), F.concat_ws(":", F.col("l").cast("string"), "parent").alias("dst"))
    links = to_record.union(nest).distinct().join(edges, ["src", "dst"], "left_anti")
    return nodes.unionByName(fresh), edges.unionByName(links)


def at_version(versions: DataFrame, key: str, version: int | None = None) -> DataFrame:
    """Each document's content at a version, by default the newest. A version that a document doesn't have gives no row."""
    if version is None:
        return versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c != key]), "version").alias("_v")).select(key, "_v.*")
    if version < 0:
        raise ValueError("versions count from 0")
    return versions.where(F.col("version") == version)


def append_version(versions: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """A version more for each document of ``new`` whose content differs from its newest; new documents start at 0."""
    last = at_version(versions, key).select(F.col(key).alias("_k"), F.col("version").alias("_n"), F.col(content).alias("_c"))
    got = new.join(last, new[key] == F.col("_k"), "left").where("_k is null or not (_c <=> " + content + ")")
    return versions.unionByName(got.select(key, F.coalesce(F.col("_n") + 1, F.lit(0)).cast(dict(versions.dtypes)["version"]).alias("version"), content))


def roll_back(versions: DataFrame, key: str, content: str, version: int) -> DataFrame:
    """The old content as a new version, so that history stays."""
    return append_version(versions, at_version(versions, key, version).select(key, content), key, content)


def upsert_records(tables: dict[str, DataFrame], new: DataFrame, base: list[str], typed: dict[str, list[str]], key: str = "record_id", kind: str = "record_type") -> dict[str, DataFrame]:
    """The ``records`` table, each type's side table and the ``is_of_type`` edges after an upsert of whole records. ``typed`` gives the columns of each type's table."""
    out = {"records": upsert(tables["records"], new.select(key, kind, *base), [key])}
    for name, columns in typed.items():
        out[name] = upsert(tables[name], new.where(F.col(kind) == name).select(key, *columns), [key])
    edges = new.where(F.col(kind).isin(*typed)).select(F.concat(F.lit("records/"), F.col(key).cast("string")).alias("src"), F.concat_ws("/", F.col(kind), F.col(key).cast("string")).alias("dst"))
    out["is_of_type"] = tables["is_of_type"].union(edges.distinct().join(tables["is_of_type"], ["src", "dst"], "left_anti"))
    return out


def delete_edges_of(edges: DataFrame, src: Any = None, dst: Any = None, kinds: list[str] = (), src_collection: str | None = None, dst_collection: str | None = None) -> DataFrame:
    """Edges but those from a node, to a node, of some kinds, or between collections (``src`` and ``dst`` being ``collection/key``); conditions given together must all hold. Without any none goes."""
    parts = [F.col(c) == v for c, v in (("src", src), ("dst", dst)) if v is not None]
    parts += [F.col("kind").isin(*kinds)] if kinds else []
    parts += [F.split_part(F.col(c), F.lit("/"), F.lit(1)) == v for c, v in (("src", src_collection), ("dst", dst_collection)) if v]
    return delete_where(edges, reduce(and_, parts)) if parts else edges


class Transaction:
    """Several tables changed together, on storage that the driver and all executors share. Each commit is one manifest that names a version of every table; readers follow the newest manifest, so
    they see all of a commit or nothing. A second writer of the same version fails and may try again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._staged: dict[str, str] = {}
        self.version = self._newest()

    def _at(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _newest(self) -> int:
        if not self._fs.exists(self._at(f"{self.path}/manifests")):
            return -1
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(self._at(f"{self.path}/manifests")) if s.getPath().getName().isdigit()), default=-1)

    def _tables(self, version: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}").first()[0]) if version >= 0 else {}

    def read(self, name: str) -> DataFrame:
        """A table as of the start of this transaction."""
        return self.spark.read.parquet(self._tables(self.version)[name])

    def write(self, name: str, df: DataFrame) -> None:
        place = f"{self.path}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(place)
        self._staged[name] = place

    def commit(self) -> int:
        if not self._staged:
            return self.version
        text, tmp = json.dumps({**self._tables(self.version), **self._staged}), f"{self.path}/.tmp-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(tmp)
        final = self._at(f"{self.path}/manifests/{self.version + 1}")
        self._fs.mkdirs(final.getParent())
        # a rename onto a folder that is there would move into it
        if self._fs.exists(final) or not self._fs.rename(self._at(tmp), final):
            self._fs.delete(self._at(tmp), True)
            self.abort()
            raise Conflict(f"version {self.version + 1} is there already")
        self.version, self._staged = self.version + 1, {}
        return self.version

    def abort(self) -> None:
        for place in self._staged.values():
            self._fs.delete(self._at(place), True)
        self._staged = {}


class Conflict(RuntimeError):
    pass


def in_transaction(spark: SparkSession, path: str, change: Callable[[Transaction], None], tries: int = 3, wait: float = 0.1) -> int:
    """Runs a change and commits it; another writer's commit in between is waited out (0.1, 0.2, 0.4 seconds) and the change is run anew. Any other error takes all of it back."""
    for n in range(tries + 1):
        t = Transaction(spark, path)
        try:
            change(t)
            return t.commit()
        except Conflict:
            if n == tries:
                raise
            time.sleep(wait * 2**n)
        except Exception:
            t.abort()
            raise
    raise AssertionError
