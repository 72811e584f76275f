"""The SQL surface: statements over registered tables, result display, catalog introspection, JDBC sources and sinks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def run(spark: SparkSession, statement: str, params: dict[str, Any] | list[Any] | None = None) -> DataFrame:
    """Parameters are bound by name (``:k``) or place (``?``), never pasted into the text."""
    return spark.sql(statement, args=params) if params else spark.sql(statement)


def display(df: DataFrame, most: int = 100) -> dict[str, Any]:
    """The first rows for display, with whether there are more; only ``most + 1`` rows reach the driver. ``row_count`` is counted by Spark."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    return {"columns": df.columns, "rows": rows[:most], "displayed_row_count": min(len(rows), most), "truncated": len(rows) > most, "row_count": len(rows) if len(rows) <= most else df.count()}


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """``database, table_name, column_name, data_type, nullable`` of all tables and views; what the catalog has is bounded."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}"
        rows += [(t.namespace[0] if t.namespace else None, t.name, t.tableType, c.name, c.dataType, c.nullable) for c in spark.catalog.listColumns(name)]
    return spark.createDataFrame(rows, "database string, table_name string, table_type string, column_name string, data_type string, nullable boolean")


def ddl(df: DataFrame, name: str) -> str:
    return f"CREATE TABLE {name} (\n  " + ",\n  ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in df.schema.fields) + "\n)"


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """With a numeric key and its bounds the read is dealt over ``parts`` tasks; filters and columns are pushed to the source."""
    if key and bounds:
        return spark.read.jdbc(url, table, column=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
    return spark.read.jdbc(url, table, properties=options)


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=options)


def metadata_table(keys: list[tuple[str, str, str, str | None]], spark: SparkSession) -> DataFrame:
    """Primary and foreign keys, which Spark's catalog lacks: (table, column, kind, referenced)."""
    return spark.createDataFrame(keys, "table_name string, column_name string, kind string, referenced string").withColumn("kind", F.upper("kind"))


def write_counted(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> int:
    """The same, and how many rows there were."""
    rows = df.observe(seen := Observation(), F.count(F.lit(1)).alias("n"))
    write_jdbc(rows, url, table, batch, **options)
    return int(seen.get["n"])


def lookup(df: DataFrame, key: str, value: Any) -> dict[str, Any] | None:
    """The row of a key, None if there is none."""
    row = df.where(F.col(key) == value).limit(1).first()
    return row.asDict(recursive=True) if row else None


def lookup_many(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key of the one column of ``keys`` with its row, nulls for a key that isn't there."""
    return keys.distinct().join(df, keys.columns[0], "left")


def scroll(df: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Some rows that match, in no order."""
    return df.where(condition).limit(limit)


def pull(df: DataFrame, batch: int = 1000) -> Iterator[list[dict[str, Any]]]:
    """All rows, a batch at a time; the driver holds one partition at most."""
    rows: list[dict[str, Any]] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(r.asDict(recursive=True))
        if len(rows) == batch:
            yield rows
            rows = []
    if rows:
        yield rows


#: fixed values: what listings of a customer system select, by object
LISTINGS = {
    "Account": "Id, Name, Industry, Phone, Website, Type, BillingCity, BillingState, BillingCountry", "Contact": "Id, FirstName, LastName, Name, Email, Phone, Title, Department, Account.Name",
    "Lead": "Id, FirstName, LastName, Name, Company, Email, Phone, Status, LeadSource, Title", "Opportunity": "Id, Name, StageName, Amount, CloseDate, Probability, Account.Name, Type",
    "Case": "Id, CaseNumber, Subject, Status, Priority, Origin, Description, Account.Name, Contact.Name", "Product2": "Id, Name, ProductCode, Description, Family, IsActive, QuantityUnitOfMeasure",
    "Pricebook2": "Id, Name, Description, IsActive, IsStandard", "Task": "Id, Subject, Status, Priority, ActivityDate, Description, OwnerId, Owner.Name, WhatId, What.Name, WhoId, Who.Name",
}


def listing(df: DataFrame, name: str | None, condition: Column | None = None, limit: int = 20, columns: str = "Id, Name, LastModifiedDate") -> DataFrame:
    """The newest rows of an object's table that match, with the columns of its listing; ``Pricebook2`` lists standard ones first, then by name."""
    got = df if condition is None else df.where(condition)
    by = [F.desc("IsStandard"), F.asc("Name")] if name == "Pricebook2" else [F.desc("LastModifiedDate"), F.asc("Id")]
    wanted = [c.strip() for c in LISTINGS.get(name, columns).split(",")]
    return got.orderBy(*by).limit(limit).select(*[F.col(c).alias(c.replace(".", "")) for c in wanted])


def first_of(df: DataFrame, column: str, **equal: Any) -> DataFrame:
    """One column of the one row with these values."""
    return df.where(reduce(and_, [F.col(k) == v for k, v in equal.items()], F.lit(True))).select(column).limit(1)


def read_objects(spark: SparkSession, path: str, pattern: str = "*", after: str | None = None, before: str | None = None, **options: str) -> DataFrame:
    """Objects of a bucket or folder: ``path, modificationTime, length, content``, those changed after (or before) a time such as 2024-05-01T00:00:00. Column pruning leaves contents unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).options(**options)
    for name, at in (("modifiedAfter", after), ("modifiedBefore", before)):
        if at:
            reader = reader.option(name, at)
    return reader.load(path)


def write_points(points: DataFrame, path: str, batch: int = 1000, workers: int = 5, key: str = "point_id") -> None:
    """Points as files of at most ``batch`` rows, written by ``workers`` tasks at a time, told apart by key so that a repeated run deals them alike."""
    points.repartition(workers, key).write.option("maxRecordsPerFile", batch).mode("overwrite").parquet(path)


def write_indexed(df: DataFrame, name: str, buckets: int, by: list[str], sort: list[str] = (), partition: list[str] = ()) -> None:
    """A table laid out for look-ups, in place of an index: ``by`` is bucketed (equality and joins without a shuffle), ``sort`` orders files (ranges skip row groups), ``partition`` prunes folders."""
    w = df.write.mode("overwrite").bucketBy(buckets, *by)
    w = w.sortBy(*sort) if sort else w
    (w.partitionBy(*partition) if partition else w).saveAsTable(name)
