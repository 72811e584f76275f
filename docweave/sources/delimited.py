"""Delimited files without a header assumption: raw rows, the tables found in them, rows as blocks, CSV output."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE = "file {kind}, table_no long, start_row long, end_row long, rows array<array<string>>"


def read_rows(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', encoding: str = "utf-8") -> DataFrame:
    """Rows of a file of any size, as strings; Spark splits the file."""
    return spark.read.csv(path, sep=delimiter, quote=quote, encoding=encoding, header=False, inferSchema=False)


def raw_rows(files: DataFrame, key: str, content: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """``file, row_number, cells`` of whole files: rows in their order (from 1), with as many cells as each has. A null or empty file has none."""
    kind = dict(files.dtypes)[key]

    def run(frames):
        for frame in frames:
            out = [(k, n, cells) for k, text in zip(frame[key], frame[content]) for n, cells in enumerate(csv.reader(io.StringIO(text or "", newline=""), delimiter=delimiter, quotechar=quote), 1)]
            yield pd.DataFrame(out, columns=["file", "row_number", "cells"])

    return files.select(key, content).mapInPandas(run, f"file {kind}, row_number long, cells array<string>")


def regions(grid: list[list[str]]) -> list[tuple[int, int, list[list[str]]]]:
    """The tables of a grid: first row, last row (from 0) and cells, empty ones as ``null``.

    A table starts at the first cell that has text and is in no table yet. It reaches right over all columns that have text somewhere below
    its first row, and down to the first empty row; an empty second row doesn't end it. A column's and a row's emptiness come from
    sets of filled places, so a table costs its own cells.
    """
    filled = {(r, c): v.strip() for r, row in enumerate(grid) for c, v in enumerate(row) if v and v.strip()}
    lowest: dict[int, int] = {}
    for r, c in filled:
        lowest[c] = max(lowest.get(c, -1), r)
    taken: set[tuple[int, int]] = set()
    found = []
    for place in sorted(filled):
        if place in taken:
            continue
        top, left = place
        right = left
        while lowest.get(right + 1, -1) >= top:
            right += 1
        bottom, r = top, top + 1
        while r < len(grid):
            if any((r, c) in filled for c in range(left, right + 1)):
                bottom = r
            elif r != top + 1:
                break
            r += 1
        cells = [[filled.get((i, c), "null") for c in range(left, right + 1)] for i in range(top, bottom + 1)]
        taken.update((i, c) for i in range(top, bottom + 1) for c in range(left, right + 1) if (i, c) in filled)
        found.append((top, bottom, cells))
    return found


def tables(files: DataFrame, key: str, content: str, delimiter: str = ",", quote: str = '"') -> DataFrame:
    """One row a table of each file (its whole text in ``content``): ``file, table_no, start_row, end_row, rows``, rows counted from 1. A file is the unit
    of work; a null or empty one has no tables."""
    kind = dict(files.dtypes)[key]

    def run(frames):
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[content]):
                grid = list(csv.reader(io.StringIO(text or "", newline=""), delimiter=delimiter, quotechar=quote))
                out += [(k, n, a + 1, z + 1, cells) for n, (a, z, cells) in enumerate(regions(grid))]
            yield pd.DataFrame(out, columns=["file", "table_no", "start_row", "end_row", "rows"])

    return files.select(key, content).mapInPandas(run, TABLE.format(kind=kind))


def row_blocks(found: DataFrame) -> DataFrame:
    """A block a data row, the first row being the header: ``file, table_no, row_number, text`` and the group's size."""
    from docweave.functions.text import row_text

    head = F.get("rows", F.lit(0))
    body = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    got = found.select("file", "table_no", head.alias("head"), F.size(body).alias("n_rows"), F.posexplode(body).alias("i", "cells"))
    return got.select("file", "table_no", (F.col("i") + 1).alias("row_number"), row_text(F.col("head"), F.col("cells")).alias("text"), "n_rows")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, encoding="UTF-8", mode="errorifexists")
