"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are cut into pieces of at most the capacity. Only the count of pieces of
each length reaches the driver (as many rows as the capacity at most); best-fit
decreasing runs over these counts, with runs of equal sequences in place of single
ones. Each piece then takes the planned slot of its rank among pieces of its length.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
PLAN = "length long, rank_from long, rank_to long, first_sequence long, in_each long, slot long"
#: White space of Unicode; unlike str.split() without the separators U+001C to U+001F, which are symbols to the tokenizer.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each core has a worker of its own
    return Tokenizer.from_file(path)


class TextIds:
    """Encodes texts; a worker keeps one from task to task. The tokenizer drops white space and its patterns never cross it, so words are encoded one by one, each distinct one once while it is remembered.

    The patterns cut a word into parts, each of which ends in a token that ends words. So the parts of many new words
    go to the library as one text, and the ids are dealt back by those tokens.
    """

    def __init__(self, path: str):
        self.library, self.known, self.chars = _library(path), {}, 0
        self.ends = frozenset(i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.endswith("</w>"))
        self.words = re.compile(f"[^{SPACE}]+").findall
        #: Letters whose case or class the library decides, odd separators, and special strings, which have one case.
        self.wide = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f]").search
        self.cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+").findall

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def solve(self, fresh: list[str]) -> None:
        known, pack, ends = self.known, struct.pack, self.ends
        mixed = [(w, self.cut(w)) for w in fresh if not w.isalpha()]
        wanted = {w for w in fresh if w.isalpha()}
        wanted.update(p for _, parts in mixed for p in parts)
        wanted = list(wanted.difference(known))
        for at in range(0, len(wanted), 1000):
            lot, found, own = wanted[at : at + 1000], [], []
            for i in self.encoded([" ".join(lot)])[0]:
                own.append(i)
                if i in ends:
                    found.append(pack(f"<{len(own)}I", *own))
                    own = []
            if own or len(found) != len(lot):
                found = [pack(f"<{len(ids)}I", *ids) for ids in self.encoded(lot)]
            known.update(zip(lot, found))
        part = known.__getitem__
        for w, parts in mixed:
            if len(parts) > 1:
                known[w] = b"".join(map(part, parts))

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.wide(text) or "<|" in text:
            words = list(dict.fromkeys(spelled := self.words(text)))
            ids = dict(zip(words, (struct.pack(f"<{len(x)}I", *x) for x in self.encoded(words))))
            return b"".join(map(ids.__getitem__, spelled))
        words = text.lower().split()
        fresh = list(set(words).difference(self.known))
        if not fresh:
            return b"".join(map(self.known.__getitem__, words))
        self.solve(fresh)
        out = b"".join(map(self.known.__getitem__, words))
        self.chars += sum(map(len, fresh))
        if len(self.known) > C.WORDS_KEPT or self.chars > C.BLOCK_CHARS:
            self.known, self.chars = {}, 0
        return out


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document, with the task that made them and their rank among its pieces of that length."""

    def run(batches):
        ids_of, seen, task = C.held(("packing", path), lambda: TextIds(path)), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for keys, texts in C.blocks(batches, "doc_id", "text"):
            out: list[list] = [[] for _ in range(6)]
            for key, text in zip(keys, texts):
                ids = ids_of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    for column, value in zip(out, (key, piece, at // 4, length, zlib.crc32(part), int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(x, k) for x, k in zip(out, kinds)] + [pa.array(np.full(len(out[0]), task, np.int32)), pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, T.StructType.fromDDL(PIECES))


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of PLAN: pieces of a length, of ranks from rank_from to before rank_to, go in_each to a sequence from first_sequence on, the first at slot.

    Best-fit decreasing; sequences filled alike stand as one run, so the work and the plan depend on the capacity, not on the number of pieces.
    """
    plan, runs, rooms, opened = [], {}, [], 0

    def leave(room: int, first: int, n: int) -> None:
        if not room or not n:
            return
        if room not in runs:
            runs[room] = []
            bisect.insort(rooms, room)
        runs[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            each = min(room // length, left)
            used = min(n, left // each)
            plan.append((length, rank, rank + used * each, first, each, capacity - room))
            rank, left = rank + used * each, left - used * each
            leave(room - each * length, first, used)
            leave(room, first + used, n - used)
    return plan


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece.

    docs: doc_id, text; other columns are ignored. A null text is an empty one, whose
    only token is end_id; a null doc_id stays null; each of several equal rows is packed;
    an empty table gives no rows. Longer documents than the capacity are cut at its
    multiples. path: a tokenizer file of the tokenizers library that drops white space.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    cut = C.checkpointed(pieces(docs, path, capacity, end_id))  # the ranks below hold for these very rows
    by_task = cut.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = cut.sparkSession.createDataFrame(plan_best_fit(counts, capacity), PLAN)
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank"))
    slots = F.broadcast(plan.withColumnRenamed("length", "of_length"))  # its size depends on the capacity alone
    placed = ranked.join(slots, (F.col("length") == F.col("of_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(nth / F.col("in_each"))).alias("sequence_id"),
        (F.col("slot") + (nth % F.col("in_each")) * F.col("length")).alias("offset"),
    )
