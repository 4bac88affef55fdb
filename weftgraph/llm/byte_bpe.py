"""Byte-level BPE encoding and decoding by merge replay over the corpus.

1. One aggregation over the pre-tokens of all texts tells in how many parts of the corpus each word stands. Words that are tokens
   need no merge and take no part.
2. Words of several parts are replayed once for all of them, in shards: they lie one after the other in one
   array of tokens; an inverted index holds, for each merge, the positions where its pair stands; merges are applied
   in rank order to all their positions at once, and only the pairs with a touched neighbour are indexed anew. As
   words do not depend on each other, shards give what one replay over the whole corpus would.
3. Their ids are joined back to the texts by broadcast, as there are at most SHARED of them, those of the most parts. A word of one part
   alone, and one beyond that bound, is replayed likewise where its text is encoded.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Words, of so many bytes at most, that are sent to all executors with their ids.
SHARED, LONGEST = 200_000, 100


class MergeReplay:
    """Encodes many words at once by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.codes = np.array(sorted(pairs), np.int64)
        self.merges = np.array([pairs[c] for c in self.codes.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, -1 without one."""
        codes = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes) & (left >= 0) & (right >= 0), self.merges[at], -1)

    def one(self, word: bytes) -> list[int]:
        """The lowest rank first, leftmost among equals, for one word."""
        parts = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            found = self.pair_ranks(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
            if found.max() < 0:
                break
            at = int(np.argmin(np.where(found < 0, np.iinfo(np.int64).max, found)))
            parts[at : at + 2] = [int(found[at])]
        return parts

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:
                out[k] = whole.to_bytes(4, "little")
            elif not w:
                out[k] = b""
            else:
                rest.append(k)
        if rest:
            for k, ids in zip(rest, self.replay([words[k] for k in rest])):
                out[k] = ids
        return out  # type: ignore[return-value]

    def replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)))  # a -1 ends each word
        ids = np.full(starts[-1] + 1, -1, np.int64)
        owner = np.repeat(np.arange(len(words)), lengths + 1)
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        ids[:-1][inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1], before[0] = n - 1, n - 1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        aside = np.zeros(len(words), bool)

        def add(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            first = np.concatenate(([0], cuts))
            for r, part in zip(ranks[first].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        found = self.pair_ranks(ids[:-1], ids[1:])
        at = np.flatnonzero(found >= 0)
        if len(at):
            add(at, found[at])
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[self.pair_ranks(ids[at], ids[after[at]]) == rank]  # others have changed since
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
                if chained.any():  # of overlapping pairs every other one, from the left
                    count = np.arange(len(at))
                    at = at[(count - np.maximum.accumulate(np.where(chained, 0, count))) % 2 == 0]
            gone = after[at]
            ids[at] = rank
            ids[gone] = -2
            after[at] = after[gone]
            before[after[gone]] = at
            both = np.concatenate((before[at], at))
            found = self.pair_ranks(ids[both], ids[after[both]])
            if len(low := both[(found >= 0) & (found < rank)]):  # no trained vocabulary does this; such words go one by one
                aside[owner[low]] = True
            keep = found > rank
            if keep.any():
                add(both[keep], found[keep])
        kept = ids[:-1] >= 0
        sizes = np.add.reduceat(kept.astype(np.int64), starts[:-1]) * 4
        ends = np.cumsum(sizes)
        whole = ids[:-1][kept].astype("<u4").tobytes()
        out = [whole[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
        for k in np.flatnonzero(aside).tolist():
            out[k] = np.array(self.one(words[k]), "<u4").tobytes()
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(2)
def codec(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


@functools.lru_cache(2)
def splitter(path: str) -> C.Splitter:
    """Finds the matches of the pre-token pattern as the tiktoken library would."""
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec(path).ranks, special_tokens={})
    suffix = library.encode_ordinary("1's")[1:]

    def kind(c: str) -> str:
        if c.isspace():
            return "\n"
        if library.encode_ordinary(f"{c}'s")[-len(suffix) :] == suffix:  # what follows a letter or number is a suffix
            return "1" if unicodedata.category(c)[0] == "N" else "a"
        return "!"

    return C.Splitter(kind)


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path


def word_parts(docs: DataFrame, path: str) -> DataFrame:
    """word (binary), parts: in how many parts of the corpus, a task's texts or less, each word stands that is no token. docs: doc_id, text."""

    def run(batches):
        C.let_go()
        split, tokens, met = splitter(path), codec(path).ranks, set()

        def rows():
            words = [w for w in (w.encode() for w in met) if len(w) <= LONGEST and w not in tokens]
            met.clear()
            for at in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 10_000], pa.binary())], ["word"])

        for _, texts in C.blocks(batches, "doc_id", "text"):
            for t in texts:
                met.update(split(t))
            if len(met) > C.WORDS_KEPT:
                yield from rows()
        yield from rows()

    return docs.mapInArrow(run, "word binary").groupBy("word").agg(F.count("*").alias("parts"))


def shared_words(docs: DataFrame, path: str) -> dict[bytes, bytes]:
    """The ids of the words that stand in most parts of the corpus, two at least, replayed once in shards."""
    counted = C.checkpointed(word_parts(docs, path).filter("parts > 1"))
    least, held = 0, 0
    for r in counted.groupBy("parts").agg(F.count("*").alias("n")).orderBy(F.desc("parts")).toLocalIterator():
        if (held := held + r["n"]) > SHARED:
            break
        least = r["parts"]
    if not least:
        return {}

    def run(batches):
        replay = codec(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(replay.encode(words), pa.binary())], ["word", "ids"])

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = counted.filter(F.col("parts") >= least).select("word").repartition(partitions, "word")
    return {bytes(r["word"]): bytes(r["ids"]) for r in shards.mapInArrow(run, "word binary, ids binary").collect()}  # SHARED rows at most


def encoded(docs: DataFrame, path: str, result, schema: str) -> DataFrame:
    """result(doc_ids, ids of each document as bytes), a batch of the schema, of all blocks of documents."""
    docs = C.pick(docs, "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(shared_words(docs, path))

    def run(batches):
        C.let_go()
        replay, split, known = codec(path), splitter(path), shared.value

        def solve(words):
            raw = [w.encode() for w in words]
            found = list(map(known.get, raw))
            own = [k for k, x in enumerate(found) if x is None]
            for k, ids in zip(own, replay.encode([raw[k] for k in own])):
                found[k] = ids
            return found

        table = C.WordTable(solve)
        for keys, texts in C.blocks(batches, "doc_id", "text"):
            numbered = [table.numbers(split(t)) for t in texts]
            ids = table.fill().__getitem__
            yield result(keys, [b"".join(map(ids, n.tolist())) for n in numbered])
            table.trim()

    return docs.mapInArrow(run, T.StructType.fromDDL(schema))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): the ids of each text.

    docs: doc_id, text; other columns are ignored. A null text is an empty one and has
    no ids; a null doc_id stays null; repeated rows give repeated results; an empty table
    gives an empty one. path: a file of base64 tokens and ranks.
    """

    def result(keys, found):
        lists = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], ["doc_id", "ids"])

    return encoded(docs, _path(path), result, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, bytes (binary), from doc_id and ids; null ids give no bytes, an unknown id is an error."""
    path = _path(path)

    def run(batches):
        tokens = codec(path).tokens.__getitem__
        for batch in batches:
            keys, lists = C.rows_of(batch, "doc_id", "ids")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([b"".join(map(tokens, x or ())) for x in lists], pa.binary())], ["doc_id", "bytes"])

    return C.pick(encoded, "doc_id", "ids").mapInArrow(run, T.StructType.fromDDL("doc_id long, bytes binary"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded bytes).

    Encodes and decodes in one pass, with the conventions of encode and decode.
    """
    path = _path(path)

    def result(keys, found):
        tokens = codec(path).tokens.__getitem__
        digest = lambda x: hashlib.sha256(x).hexdigest()
        decoded = [digest(b"".join(map(tokens, np.frombuffer(x, "<u4").tolist()))) for x in found]
        columns = [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(map(digest, found), pa.string()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded(docs, path, result, SCHEMA)
