"""Tables written to the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one process (tests, a single
machine) is a temporary folder made, once per session; a cluster without the setting is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[str] = []


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="docweave-"))
    return base.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = place(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that no plan still to be run reads; only whole ones, read as they were written."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            known = next((w for w in _written if path.rstrip("/").endswith(w.split(":", 1)[-1].lstrip("/"))), None)
            if known:
                _written.remove(known)
                _delete(t.sparkSession, known)


def release(spark: SparkSession) -> None:
    """Delete what operators wrote in this process; call once results have been consumed, as these still read it."""
    while _written:
        _delete(spark, _written.pop())


def tune(spark: SparkSession, rows: int = 512) -> None:
    """Small Arrow batches: a batch of very long texts must still fit beside the executor's heap. A smaller setting of the caller stays; theirs can't
    be put back here, as plans run after their operator has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))
