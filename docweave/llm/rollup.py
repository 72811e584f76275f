"""Token totals by source, language and tokenizer version, kept up to date by signed batches.

A change inserts a text, deletes one, or revises one: it adds the new text's counts and takes off the old
text's. A batch is reduced to one signed row a group and written to ``<path>/batch=<id>`` by a rename, which makes it whole
or absent; a batch id that is there already is skipped, so a repeated or restarted commit changes nothing. Totals are the
sums over batches; ``compact`` folds old batches into one base that remembers their ids.

Cases: null text counts as empty (a document of no tokens); null source or language is a group of its own; repeated rows
count each; an empty batch is committed and changes nothing; groups whose counts all came back to zero are left out.
"""

from __future__ import annotations

import base64
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import kernel
from docweave.llm.scratch import tune

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")


class Tokenizer:
    """Counts tokens with a public byte-level vocabulary (``.tiktoken`` ranks). The driver reads the file; tasks get its bytes."""

    def __init__(self, path: str | None = None, version: str = "byte_bpe_50k"):
        import public_tokenizers

        with open(path or public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
            self.ranks = f.read()
        self.version, self.pattern, self._encoding = version, public_tokenizers.PATTERN, None

    def __getstate__(self):
        return self.__dict__ | {"_encoding": None}

    def count(self, texts: list[str]) -> list[int]:
        if self._encoding is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
            self._encoding = tiktoken.Encoding(self.version, pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(self._encoding.encode_ordinary(t)) for t in texts]


PART = "struct<sign:int,source:string,lang:string>"


def _part(sign: int, source: str, lang: str):
    return F.struct(F.lit(sign).alias("sign"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))


def inserts(docs: DataFrame) -> DataFrame:
    """``parts, text``: each document counted to its group."""
    return docs.select(F.array(_part(1, "source", "lang")).alias("parts"), "text")


def signed(changes: DataFrame) -> DataFrame:
    """``parts, text`` from changes with ``kind`` insert, delete or revise, new values in ``source, lang, text`` and
    old ones in ``old_source, old_lang, old_text``. Other kinds count as nothing. A revision that leaves the text alone has its tokens counted once."""
    same = F.expr("kind = 'revise' and text <=> old_text")
    new, old = _part(1, "source", "lang"), _part(-1, "old_source", "old_lang")
    one = changes.where(F.expr("kind = 'insert'") | F.expr("kind = 'revise'")).select(F.when(same, F.array(new, old)).otherwise(F.array(new)).alias("parts"), "text")
    return one.union(changes.where(F.expr("kind = 'delete'") | (F.expr("kind = 'revise'") & ~same)).select(F.array(old), F.col("old_text")))


def deltas(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """One signed row a group from ``parts, text``."""
    spark = rows.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches):
        for b in batches:
            _, offs = kernel.column_bytes(b.column(1))
            for i, j in kernel.blocks(offs, 4 << 20):
                texts = [t or "" for t in b.column(1)[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(shared.value.count(texts), pa.int64()), pa.array([len(t) for t in texts], pa.int64())], ["parts", "tokens", "chars"])

    counted = rows.select(F.col("parts").cast(f"array<{PART}>").alias("parts"), "text").mapInArrow(run, f"parts array<{PART}>, tokens long, chars long")
    counted = counted.select(F.explode("parts").alias("p"), "tokens", "chars").select("p.*", "tokens", "chars")
    return counted.groupBy("source", "lang").agg(
        F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"), F.sum(F.col("sign") * F.col("chars")).alias("n_chars")
    ).select("source", "lang", F.lit(tokenizer.version).alias("tokenizer"), *SUMS)


class Rollup:
    """Totals under ``path``, on storage that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _ids(self) -> dict[str, list[str]]:
        """The folders there are and the batches that each stands for."""
        found: dict[str, list[str]] = {}
        if self._fs.exists(self._path(self.path)):
            for s in self._fs.listStatus(self._path(self.path)):
                name = s.getPath().getName()
                if name.startswith("batch="):
                    found[name] = [bytes.fromhex(name[6:]).decode()]
                elif name.startswith("base="):
                    ids = self.spark.read.text(f"{self.path}/{name}/ids").collect()
                    found[name] = [i for r in ids for i in json.loads(r[0])]
        newest = max((n for n in found if n.startswith("base=")), default=None, key=lambda n: len(found[n]))
        folded = set(found.get(newest, ()))
        return {n: ids for n, ids in found.items() if n == newest or (n.startswith("batch=") and ids[0] not in folded)}

    def commit(self, batch_id: str, rows: DataFrame, tokenizer: Tokenizer) -> bool:
        """Apply signed rows once; False if the batch is there already."""
        if any(batch_id in ids for ids in self._ids().values()):
            return False
        tmp, final = f"{self.path}/.tmp-{uuid.uuid4().hex}", f"{self.path}/batch={batch_id.encode().hex()}"
        deltas(rows, tokenizer).write.parquet(tmp)
        done = not self._fs.exists(self._path(final)) and self._fs.rename(self._path(tmp), self._path(final))
        if not done:
            self._fs.delete(self._path(tmp), True)
        return bool(done)

    def totals(self) -> DataFrame:
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
        paths = [f"{self.path}/{n}" + ("/sums" if n.startswith("base=") else "") for n in self._ids()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where(" or ".join(f"{c} <> 0" for c in SUMS))

    def compact(self) -> None:
        """Fold all batches into one base. The base becomes visible by a rename; older folders are deleted after it."""
        old = self._ids()
        ids = sorted(i for x in old.values() for i in x)
        name = uuid.uuid4().hex
        tmp = f"{self.path}/.tmp-{name}"
        self.totals().write.parquet(f"{tmp}/sums")
        self.spark.createDataFrame([(json.dumps(ids),)], "value string").write.text(f"{tmp}/ids")
        self._fs.rename(self._path(tmp), self._path(f"{self.path}/base={name}"))
        for n in old:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)


def count_table(docs: DataFrame, path: str, tokenizer: Tokenizer, batch_id: str = "documents") -> DataFrame:
    """Commit all of ``docs`` as inserts, once, and give the totals."""
    rollup = Rollup(docs.sparkSession, path)
    rollup.commit(batch_id, inserts(docs), tokenizer)
    return rollup.totals()


def history(docs: DataFrame, others: DataFrame, path: str, tokenizer: Tokenizer) -> DataFrame:
    """The totals of ``docs`` after a history of all kinds of change: the documents come without a language and get it by a revision, ``others`` (a
    column ``text``) come and are withdrawn, and every batch is given twice."""
    rollup = Rollup(docs.sparkSession, path)
    none = F.lit(None).cast("string")
    others = others.select("text", F.lit("others").alias("source"), none.alias("lang"))
    change = lambda df, kind: df.select(F.lit(kind).alias("kind"), "source", "lang", "text", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("text").alias("old_text"))
    steps = {
        "documents": inserts(docs.withColumn("lang", none)),
        "others": inserts(others),
        "languages": signed(change(docs, "revise").withColumn("old_lang", none)),
        "others withdrawn": signed(change(others, "delete")),
    }
    for name, rows in steps.items():
        rollup.commit(name, rows, tokenizer)
        rollup.commit(name, rows, tokenizer)
    return rollup.totals()
