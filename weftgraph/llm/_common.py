"""What the training-data operators share: column picking, checkpoints, word tables."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Distinct words that a Python worker remembers before it starts afresh.
WORDS_KEPT = 400_000
#: Rows of a small table that may be sent to all executors, by a count.
FEW = 1_000_000
#: Characters of text that a worker handles as one block.
BLOCK_CHARS = 8_000_000

#: Code points for which the pattern engines of the regex module and of the tokenizer libraries were compared one by one (tests/llm).
COMPARED = r"\x00-\u0557\u0590-\u088e\u2010-\u208e\u3000-\u9fff\uac00-\ud7a3\uff00-\uffef"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Columns by exact name and, among several of that name, the first.

    Other columns, also ones whose names differ in case alone, are left out.
    """
    at = [df.columns.index(n) for n in names]
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[plain[f"c{i}"].alias(n) for i, n in zip(at, names)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one if Spark runs in this process alone, and an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows with the other columns of table but weight: an inner join that sends no hot key to one task.

    table has one row for each key, with the number of its rows in ``weight``. Keys that hold more than a thousandth of all
    rows, fewer than a thousand, are joined by broadcast. Both tables are read twice, so they should be written ones.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = table.filter(F.col(weight) > total // 1000).drop(weight)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col(weight) <= total // 1000).drop(weight), keys)
    return by_broadcast.unionByName(others)


_held: dict = {}


def held(key, make):
    """What a worker keeps from task to task under a key; the first call with another key lets go of it, so that a worker holds one operator's words at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drops what the worker keeps and gives free memory back to the system, as workers live on through other operators."""
    _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Lots that ids are dealt, so many that a sample of a fixed size stays so over any table.
LOTS = 1 << 48


def lot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(LOTS))


def bound(wanted: int, n: int) -> int:
    """The lots below which about ``wanted`` of n rows are."""
    return LOTS if n <= wanted else LOTS * wanted // n


def by_batch(docs: DataFrame, make) -> DataFrame:
    """docs with each batch put through a function of batches, which ``make`` makes once a task. Columns go by place, so any names will do."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches):
        let_go()
        of = make()
        for batch in batches:
            yield of(batch)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def blocks(batches, ids: str, text: str):
    """(ids, texts) of at most BLOCK_CHARS or one document; a null text is an empty one."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, value in zip(*rows_of(batch, ids, text)):
            value = value or ""
            if texts and size + len(value) > BLOCK_CHARS:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(value)
            size += len(value)
    if keys:
        yield keys, texts


class Splitter:
    """Finds the matches of the pre-token pattern as a tokenizer library would.

    The pattern engines know different versions of Unicode. Characters outside COMPARED take part in the search as a stand-in
    of the class that the library gives them: kind(c) is "a" for a letter, "1" for a number, a line feed for white space, "!" for others.
    """

    def __init__(self, kind):
        import public_tokenizers
        import regex

        self.kind, self.known = kind, {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.strange = regex.compile(f"[^{COMPARED}]")

    def stand_in(self, m) -> str:
        c = m[0]
        if c not in self.known:
            self.known[c] = self.kind(c)
        return self.known[c]

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self.strange.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.strange.sub(self.stand_in, text))]


class WordTable(dict):
    """Numbers words as they are met; ``fill`` gives the new ones their values."""

    def __init__(self, solve):
        self.solve, self.fresh, self.values, self.chars = solve, [], [], 0

    def __missing__(self, word):
        self[word] = n = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return n

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def fill(self) -> list:
        if self.fresh:
            self.values.extend(self.solve(self.fresh))
            self.fresh = []
        return self.values

    def trim(self) -> None:
        if len(self) > WORDS_KEPT or self.chars > BLOCK_CHARS:
            self.clear()
            self.fresh, self.values, self.chars = [], [], 0
