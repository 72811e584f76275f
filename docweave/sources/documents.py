"""Documents in nested JSON, whose parts name each other by reference, as flat blocks in reading order."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = "block_index long, parent long, depth int, kind string, label string, page long, text string"
#: fixed values: the kind of block that each part of the document holds
PARTS = {"texts": "text", "groups": "group", "tables": "table", "pictures": "image"}


def _part(root: dict, ref: str):
    """The part that a reference such as ``#/texts/3`` means, and the list it is in; None if it means nothing."""
    at = root
    steps = ref.lstrip("#").strip("/").split("/")
    for s in steps:
        if isinstance(at, list) and s.isdigit() and int(s) < len(at):
            at = at[int(s)]
        elif isinstance(at, dict) and s in at:
            at = at[s]
        else:
            return None, ""
    return at if isinstance(at, dict) else None, steps[0]


def _refs(part: dict) -> list[str]:
    return [c["$ref"] for c in part.get("children") or [] if isinstance(c, dict) and isinstance(c.get("$ref"), str)]


def blocks(text: str | None) -> list[tuple]:
    """``BLOCK`` rows of one document: parts below its body in reading order, each once however often it is named, numbered from 0 without gaps. A table is followed by its rows. What isn't JSON, or has no
    body, has no blocks."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    if not isinstance(root, dict) or not isinstance(root.get("body"), dict):
        return []
    out: list[tuple] = []
    seen: set[str] = set()
    # references still to be taken, the next one last: a document may nest deeper than calls may
    todo = [(r, None, 0) for r in reversed(_refs(root["body"]))]
    while todo:
        ref, parent, depth = todo.pop()
        if ref in seen:
            continue
        seen.add(ref)
        part, where = _part(root, ref)
        if part is None or where not in PARTS:
            continue
        here = len(out)
        pages = [p.get("page_no") for p in part.get("prov") or [] if isinstance(p, dict)]
        page = next((p for p in pages if isinstance(p, int)), None)
        out.append((here, parent, depth, PARTS[where], part.get("label"), page, part.get("text") if where == "texts" else None))
        if where == "tables":
            for row in (part.get("data") or {}).get("grid") or []:
                cells = [str(c.get("text") or "") for c in row if isinstance(c, dict)]
                out.append((len(out), here, depth + 1, "table_row", None, page, " | ".join(cells)))
        todo += [(r, here, depth + 1) for r in reversed(_refs(part))]
    return out


def document_blocks(files: DataFrame, key: str, content: str) -> DataFrame:
    """The blocks of each document; a document is the unit of work."""
    kind = dict(files.dtypes)[key]
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(k, *b) for k, text in zip(frame[key], frame[content]) for b in blocks(text)]
            got = pd.DataFrame(rows, columns=["file", *names])
            yield got.astype({"parent": "Int64", "page": "Int64"})

    return files.select(key, content).mapInPandas(run, f"file {kind}, {BLOCK}")
