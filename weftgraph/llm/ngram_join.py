"""Similarity join of documents on word shingles: rare-first prefixes, filters, one check for each pair.

1. A document's distinct shingles are hashed to 64 bits. Documents with equal sets form one
   class; all that follows is done once for a class.
2. A table of counters of a fixed size, filled from all documents, tells about how frequent
   a shingle is. It orders each set, rare ones first; any order gives the same result.
3. Sets with the asked likeness share a shingle among the first of both (prefix filter). The
   shingles of prefixes are dealt out by hash; within a list, pairs must pass the length and
   the positional filter.
4. A short list gives all such pairs. A long one gives chains in three orders; once their
   links are known, it gives only pairs of classes that are not yet connected, of sizes that can be alike, a few
   hundred members against a few hundred in a task. So thousands of near copies are not multiplied out and yet no connection is
   missed. Those pairs must also pass a bound by parity maps (``parities``). A very long list is dealt to several tasks, with
   leaders of all its parts in one more.
5. What the counted common shingles and the suffixes can add up to is the suffix filter. Each
   pair that is left is checked once on the whole sets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C
from weftgraph.llm.components import connected

SCHEMA = "doc_id long, n_shingles long, component_id long"
SIZE, PERCENT = 5, 75
#: Counters for the order of shingles, and the parts in which they travel.
COUNTERS, PARTS = 1 << 22, 64
#: Lists of at most so many members give all their pairs at once.
SHORT = 12
#: A list that seems to have so many members (and far more than the counters' mean) is dealt to several tasks.
HOT = 1_000_000
#: Members of a list that are matched with as many others at once, where pairs that are not connected yet are looked for.
CHUNK = 256
#: Bits of a set's parity map; a multiple of 64.
BITS = 1024

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class Shingler:
    """The sorted distinct hashes of a text's shingles."""

    def __init__(self, size: int = SIZE):
        from xxhash import xxh64_intdigest

        class Words(dict):
            def __missing__(self, word):
                self[word] = h = xxh64_intdigest(word)
                return h

        self.size, self.digest, self.words = size, xxh64_intdigest, Words()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([self.digest(b" ".join(words), 1)], np.uint64)
        if len(self.words) > C.WORDS_KEPT:
            self.words.clear()
        hashes = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.size + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.size):
            out = (out ^ hashes[i : i + n]) * _MIX[i % len(_MIX)]
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def ids(self, found: np.ndarray) -> tuple[int | None, int | None]:
        """Two hashes of the set, the first to name the class of documents with this set."""
        if not len(found):
            return None, None
        raw = found.tobytes()
        return self.digest(raw, 7) - (1 << 63), self.digest(raw, 8) - (1 << 63)

    def node(self, found: np.ndarray, renamed: dict[tuple[int, int], int]) -> int | None:
        """The class of documents with this set."""
        ids = self.ids(found)
        return renamed.get(ids, ids[0])


def parities(found: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the number of shingles that fall on it. Two sets' maps differ in no more bits than the sets have shingles not in common."""
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def needed(na, nb, percent: int):
    """The least size of an intersection with the asked share of the union."""
    return -(-percent * (na + nb) // (100 + percent))


def _passes(na, nb, ia, ib, percent: int):
    """Length and positional filter, for a first common shingle at places ia and ib."""
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (np.minimum(na - ia, nb - ib) >= needed(na, nb, percent))


def classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n, node, second (both hashes of the set), bits (its parity map) of each document; and, with a part, the counts of shingles by counter."""

    def run(batches):
        shingles, counts = C.held(("shingles", size), lambda: Shingler(size)), np.zeros(COUNTERS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("bits", pa.list_(pa.int64())), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            ids, texts = C.rows_of(batch, "doc_id", "text")
            sizes, nodes, maps, waiting, held = [], [], [], [], 0
            for text in texts:
                found = shingles(text)
                sizes.append(len(found))
                nodes.append(shingles.ids(found))
                maps.append(parities(found))
                waiting.append(found % np.uint64(COUNTERS))
                held += len(found)
                if held > 2_000_000:
                    np.add.at(counts, np.concatenate(waiting).astype(np.int64), 1)
                    waiting, held = [], 0
            if held:
                np.add.at(counts, np.concatenate(waiting).astype(np.int64), 1)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": sizes, "node": [x[0] for x in nodes], "second": [x[1] for x in nodes], "bits": maps, "part": none, "counts": none}, schema)
        if counts.any():
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
            none = [None] * PARTS
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "node": none, "second": none, "bits": none, "part": range(PARTS), "counts": parts}, schema)

    return docs.mapInArrow(run, T.StructType.fromDDL("doc_id long, n long, node long, second long, bits array<long>, part int, counts binary"))


def per_node(of: DataFrame) -> DataFrame:
    """node, least (doc_id), rows, low and high (of second) of each set."""
    of = of.filter("node is not null").groupBy("node")
    return C.checkpointed(of.agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.min("second").alias("low"), F.max("second").alias("high")))


def namesakes(of: DataFrame, per: DataFrame) -> dict[tuple[int, int], int]:
    """Other names for sets whose first hash is that of another set, by both hashes.

    Of k sets about k * k / 2^65 share a hash of 64 bits, a few of ten billion; those of the smallest second hash keep the name.
    """
    shared = per.filter("low <> high").select("node", "low")
    if shared.isEmpty():
        return {}
    others = of.join(F.broadcast(shared), "node").filter("second <> low").select("node", "second").distinct().collect()  # a few rows, as said
    return {(r["node"], r["second"]): zlib.crc32(f"{r['node']} {r['second']}".encode()) << 31 ^ r["second"] for r in others}


def levels(counted: DataFrame) -> bytes:
    """A byte for each counter: its count on a scale of eighths of a doubling."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(*C.rows_of(batch, "part", "counts")):
                found = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[part] = sums[part] + found if part in sums else found
        for part, found in sums.items():
            level = np.minimum(255, 8 * np.log2(found + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["part", "level"])

    rows = counted.repartition(PARTS, "part").mapInArrow(run, "part int, level binary").collect()  # PARTS rows
    found = {r["part"]: bytes(r["level"]) for r in rows}
    return b"".join(found.get(k, bytes(COUNTERS // PARTS)) for k in range(PARTS))


ENTRY = np.dtype([("home", "<u4"), ("key", "<u4"), ("node", "<i8"), ("n", "<u4"), ("place", "<u4")])
#: Marks of ``home``, the bucket that a shingle belongs to: an entry of a list that is dealt to several tasks, and a copy of one for the list's leaders.
SPLIT, LEADER = np.uint32(1 << 30), np.uint32(1 << 31)


def hot_limit(level: bytes, hot: int) -> float:
    return hot + 4 * float(np.exp2(np.frombuffer(level, np.uint8) / 8.0).mean())


def _dealt(entry: np.ndarray, found: np.ndarray, count: np.ndarray, buckets: int, limit: float) -> np.ndarray:
    """The entries with their buckets. Those of a hot list go to several, by node, and some of them, its leaders, once more to one."""
    home = (found % np.uint64(buckets)).astype(np.uint32)
    entry["home"], entry["bucket"] = home, home
    parts = np.where(count > limit, count / limit + 1, 1).astype(np.uint64)
    hot = parts > 1
    if not hot.any():
        return entry
    mixed = entry["node"].view(np.uint64) * _MIX[2] >> np.uint64(17)
    entry["bucket"] = np.where(hot, (home + (mixed % parts + np.uint64(1)) * np.uint64(7919)) % np.uint64(buckets), home)
    entry["home"] = np.where(hot, home | SPLIT, home)
    leaders = entry[hot & (mixed // parts % parts == 0)]
    leaders["bucket"], leaders["home"] = leaders["home"] & (SPLIT - np.uint32(1)), leaders["home"] | LEADER
    return np.concatenate((entry, leaders))


def prefixes(docs: DataFrame, level: bytes, size: int, percent: int, buckets: int, hot: int, renamed: dict) -> DataFrame:
    """bucket, entries: the prefix shingles of each class, packed by bucket."""
    table, limit = docs.sparkSession.sparkContext.broadcast(level), hot_limit(level, hot)  # COUNTERS bytes

    def run(batches):
        order, shingles = np.frombuffer(table.value, np.uint8), C.held(("shingles", size), lambda: Shingler(size))
        for _, texts in C.blocks(batches, "doc_id", "text"):
            seen, parts = set(), []
            for text in texts:
                found = shingles(text)
                n, node = len(found), shingles.node(found, renamed)
                if not n or node in seen:
                    continue
                seen.add(node)
                take = n - -(-percent * n // 100) + 1
                rarity = order[(found % np.uint64(COUNTERS)).astype(np.int64)]
                rank = rarity.astype(np.uint64) << np.uint64(56) | found >> np.uint64(8)
                first = np.argpartition(rank, take - 1)[:take] if take < n else np.arange(n)
                first = first[np.argsort(rank[first])]
                entry = np.empty(take, [("bucket", "<i4"), *ENTRY.descr])
                entry["key"] = found[first] >> np.uint64(32)
                entry["node"], entry["n"], entry["place"] = node, n, np.arange(take)
                parts.append(_dealt(entry, found[first], np.exp2(rarity[first] / 8.0), buckets, limit))
            if not parts:
                continue
            every = np.concatenate(parts)
            every = every[np.argsort(every["bucket"], kind="stable")]
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(every["bucket"])) + 1, [len(every)]))
            blobs = [b"".join(np.ascontiguousarray(every[c][a:b]).tobytes() for c in ENTRY.names) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(every["bucket"][cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    return docs.mapInArrow(run, T.StructType.fromDDL("bucket int, entries binary"))


def _unpacked(blob: bytes) -> np.ndarray:
    m = len(blob) // ENTRY.itemsize
    out, at = np.empty(m, ENTRY), 0
    for name in ENTRY.names:
        width = ENTRY[name].itemsize
        out[name] = np.frombuffer(blob, ENTRY[name], m, at)
        at += width * m
    return out


PAIR = ["a", "b", "n_a", "n_b", "hits", "passes"]


def _pairs(e: np.ndarray, first: np.ndarray, second: np.ndarray, percent: int, hit: int) -> np.ndarray:
    """Rows of PAIR, a < b, for entries of one list that pass the length filter; passes tells of the positional one."""
    n, place = e["n"].astype(np.int64), e["place"].astype(np.int64)
    keep = 100 * np.minimum(n[first], n[second]) >= percent * np.maximum(n[first], n[second])
    keep &= e["node"][first] != e["node"][second]
    first, second = first[keep], second[keep]
    swap = e["node"][first] > e["node"][second]
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    passes = _passes(n[first], n[second], place[first], place[second], percent)
    return np.stack((e["node"][first], e["node"][second], n[first], n[second], np.full(len(first), hit), passes.astype(np.int64)), 1)


def _tallied(rows: list[np.ndarray]) -> np.ndarray:
    """One row for each pair: hits added up, passes if any did."""
    every = np.concatenate(rows)
    every = every[np.lexsort((every[:, 1], every[:, 0]))]
    begin = np.flatnonzero(np.concatenate(([True], (every[1:, 0] != every[:-1, 0]) | (every[1:, 1] != every[:-1, 1]))))
    out = every[begin]
    out[:, 4], out[:, 5] = np.add.reduceat(every[:, 4], begin), np.maximum.reduceat(every[:, 5], begin)
    return out


def lists(packed: DataFrame, percent: int, partitions: int) -> DataFrame:
    """Rows of two kinds: pairs (PAIR; hits counts common shingles in short lists) and, with a list, members (a, n_a, place) of long lists.

    Different shingles of a document that fall into one list count each, so hits may be too many, but not too few.
    """

    def buckets(batches):
        """The entries of one bucket after the other; the rows come in their order."""
        at, held = None, []
        for batch in batches:
            for bucket, blob in zip(*C.rows_of(batch, "bucket", "entries")):
                if bucket != at and held:
                    yield np.concatenate(held)
                    held = []
                at = bucket
                held.append(_unpacked(blob))
        if held:
            yield np.concatenate(held)

    def run(batches):
        for e in buckets(batches):
            lists = e["home"].astype(np.uint64) << np.uint64(32) | e["key"]
            order = np.lexsort((e["place"], e["node"], lists))
            e, lists = e[order], lists[order]
            fresh = np.concatenate(([True], (lists[1:] != lists[:-1]) | (e["node"][1:] != e["node"][:-1]) | (e["place"][1:] != e["place"][:-1])))
            e, lists = e[fresh], lists[fresh]  # without copies from other blocks
            begin = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
            count = np.diff(np.append(begin, len(e)))
            split = e["home"] >= SPLIT
            many = np.where(split, SHORT + 1, np.repeat(count, count))  # a part of a list is never a short one
            e, lists, many = e[many > 1], lists[many > 1], many[many > 1]
            found = []
            for step in range(1, SHORT):  # all pairs of short lists, at each distance
                at = np.flatnonzero((lists[step:] == lists[:-step]) & (many[step:] <= SHORT))
                if not len(at):
                    break
                found.append(_pairs(e, at, at + step, percent, 1))
            e, lists = e[many > SHORT], lists[many > SHORT]
            if len(e):
                mixed = e["node"].view(np.uint64)
                for lot in (e["n"], mixed * _MIX[0] >> np.uint64(20), mixed * _MIX[1] >> np.uint64(20)):
                    order = np.lexsort((lot, lists))
                    at = np.flatnonzero(lists[order[1:]] == lists[order[:-1]])
                    pairs = _pairs(e, order[at], order[at + 1], percent, 0)
                    found.append(pairs[pairs[:, 5] > 0])
            if found and sum(map(len, found)):
                pairs = _tallied(found)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, *[pa.array(np.ascontiguousarray(c)) for c in pairs.T], none], ["list", *PAIR, "place"])
            e = e[e["home"] < LEADER]  # leaders are members of their parts
            if m := len(e):
                name = (e["home"] & (SPLIT - np.uint32(1))).astype(np.int64) << np.int64(32) | e["key"].astype(np.int64)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(e["node"].copy()), none, pa.array(e["n"].astype(np.int64)), none, none, none, pa.array(e["place"].astype(np.int64))], ["list", *PAIR, "place"])

    return packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, T.StructType.fromDDL("list long, a long, b long, n_a long, n_b long, hits long, passes long, place long"))


def candidates(found: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, n_a, n_b) that pass the positional and the suffix filter.

    Common shingles are those of both prefixes, of which the hits and at most each document's entries in long lists tell,
    and no more than what follows one of the prefixes.
    """
    pairs = found.filter("list is null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("hits").alias("hits"), F.max("passes").alias("passes")).filter("passes > 0")
    long = members.groupBy("node").agg(F.count("*").alias("long"))
    for side in "ab":
        pairs = pairs.join(long.select(F.col("node").alias(side), F.col("long").alias(f"long_{side}")), side, "left")
    after = F.greatest(F.ceil(percent * F.col("n_a") / 100), F.ceil(percent * F.col("n_b") / 100)) - 1
    most = F.col("hits") + F.coalesce(F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))), F.lit(0)) + after
    return pairs.filter(most >= _need(F.col("n_a") + F.col("n_b"), percent)).select("a", "b", "n_a", "n_b")


def _need(both, percent: int):
    return F.ceil(percent * both / (100 + percent))


def sets_of(docs: DataFrame, per: DataFrame, nodes: DataFrame, size: int, renamed: dict) -> DataFrame:
    """node, hashes of the asked nodes, from the documents that have the least id of one of them. per: as of per_node."""
    wanted = C.checkpointed(per.join(nodes, "node").select(F.col("least").alias("wanted")).distinct())
    if wanted.count() <= C.FEW:
        wanted = F.broadcast(wanted)
    chosen = docs.join(wanted, docs["doc_id"].eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches):
        shingles = C.held(("shingles", size), lambda: Shingler(size))
        for batch in batches:
            column = batch.column(0)
            for at in range(0, len(column), 500):
                found = [shingles(t) for t in column.slice(at, 500).to_pylist()]
                found = [x for x in found if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([shingles.node(x, renamed) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["node", "hashes"])

    sets = chosen.select("text").mapInArrow(run, T.StructType.fromDDL("node long, hashes array<long>"))
    return sets.dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the asked likeness. A node in over a thousandth of the pairs is joined in several parts."""
    limit = pairs.count() // 1000 + 1
    both = pairs
    for side, other, name in (("a", "b", "x"), ("b", "a", "y")):
        busy = pairs.groupBy(side).agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")).filter("parts > 1")  # fewer than 1000
        one = F.lit(1)
        spread = sets.select(F.col("node").alias(side), F.col("hashes").alias(name)).join(F.broadcast(busy), side, "left")
        spread = spread.select(side, name, F.explode(F.sequence(one, F.coalesce("parts", one))).alias("lot"))
        both = both.join(F.broadcast(busy), side, "left").withColumn("lot", F.pmod(F.xxhash64(other), F.coalesce("parts", one)).cast("int") + 1).drop("parts")
        both = both.join(spread, [side, "lot"]).drop("lot")
    return both.filter(F.size(F.array_intersect("x", "y")) >= _need(F.size("x") + F.size("y"), percent)).select("a", "b")


def _checked(docs, per, pairs, size, percent, renamed) -> DataFrame:
    nodes = C.checkpointed(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    return C.checkpointed(verified(pairs.select("a", "b"), C.checkpointed(sets_of(docs, per, nodes, size, renamed)), percent))


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    Words are runs of anything but ASCII white space, with A-Z as a-z; a set holds the distinct shingles
    of ``size`` words, or the whole sequence where there are fewer. Documents link when their sets' intersection
    is at least ``percent`` hundredths of the union; component_id is the smallest doc_id that links lead to.

    docs: doc_id, text; other columns are ignored. A null or wordless text has 0 shingles and is its own
    component. Rows of equal sets always link, rows of equal doc_id do not by that alone. Null doc_ids take part but name
    a component only if it has no other. An empty table gives an empty one. Sets are compared by 64-bit hashes of their shingles;
    equal sets are told by 128 bits.
    Links inside a connected group are not all looked for, so they are neither listed nor counted.
    """
    return grouped(docs, size, percent, hot)[0].select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def grouped(docs: DataFrame, size: int, percent: int, hot: int = HOT) -> tuple[DataFrame, dict]:
    """(doc_id, n, node, component, component_id of each row of docs; the sets with other names): node (of the set) and component (a node) are null where there are no shingles."""
    docs = C.pick(docs, "doc_id", "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = C.checkpointed(classes(docs, size))
    of = first.filter("part is null").select("doc_id", "n", "node", "second", "bits")
    per = per_node(of)
    renamed = namesakes(of, per)
    if renamed:
        names = docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "node long, second long, name long")
        of = of.join(F.broadcast(names), ["node", "second"], "left").withColumn("node", F.coalesce("name", "node")).drop("name")
        per = per_node(of)
    bits = of.filter("node is not null").select("node", "bits").dropDuplicates(["node"])
    of = of.drop("second", "bits")
    level = levels(first.filter("part is not null").select("part", "counts"))
    found = C.checkpointed(lists(prefixes(docs, level, size, percent, 8 * partitions, hot, renamed), percent, partitions))
    members = found.filter("list is not null").select("list", F.col("a").alias("node"), F.col("n_a").alias("n"), "place")
    pairs = C.checkpointed(candidates(found, members, percent))
    links = _checked(docs, per, pairs, size, percent, renamed)
    joined = C.checkpointed(connected(links))
    if not members.isEmpty():
        more = C.checkpointed(open_pairs(members, joined, percent, bits).join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            joined = C.checkpointed(connected(links.unionByName(_checked(docs, per, more, size, percent, renamed))))
    named = per.select("node", "least", "rows").join(joined, "node", "left")
    named = C.checkpointed(named.withColumn("component", F.coalesce("component", "node")))
    least = C.checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes")))
    by_node = C.checkpointed(C.looked_up(named.select("node", "rows", "component"), least, ["component"], "nodes"))
    full = C.looked_up(of.filter("node is not null"), by_node, ["node"], "rows").select("doc_id", "n", "node", "component", "component_id")
    none = F.lit(None).cast("long")
    return full.unionByName(of.filter("node is null").select("doc_id", "n", "node", none.alias("component"), F.col("doc_id").alias("component_id"))), renamed


def open_pairs(members: DataFrame, joined: DataFrame, percent: int, bits: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a, b) of members of a list that pass the filters and are not connected yet, each from the first list that both are in.

    bits: node, bits (parity map) of all nodes; without it, that bound is left out. Maps that differ in h bits leave at most (n_a + n_b - h) / 2 shingles in common, so members of a
    group of near copies that few others are like do not meet the whole group in the check. Maps of sets far larger than BITS stop little.
    Later lists cannot let a pair through that the first one stops, as places only grow. Members are dealt by classes of size, so that
    sets that can be alike are in one class or in two that touch, and the classes to parts of about CHUNK members; two parts meet in a task of their own.
    """
    placed = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grade = F.floor(F.log(F.col("n").cast("double")) / (np.log(100 / percent) * (1 + 1e-9))).cast("int")
    placed = C.checkpointed(placed.withColumn("grade", grade))
    mixed = placed.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many")).filter("low <> high")
    mixed = C.checkpointed(mixed.select("list", "many"))
    fewer = mixed.count() <= C.FEW
    left = C.checkpointed(placed.join(F.broadcast(mixed.select("list")) if fewer else mixed.select("list"), "list", "left_semi"))
    lists_of = left.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "list"))).alias("lists"))  # of one document's prefix
    earlier = F.transform(F.filter("lists", lambda x: x["place"] < F.col("place")), lambda x: x["list"])
    left = left.join(lists_of, "node").withColumn("earlier", earlier).drop("lists")
    if bits is not None:
        left = left.join(bits, "node")
    large = left.groupBy("list", "grade").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).filter("parts > 1")
    large = C.checkpointed(large)
    few = large.count() <= C.FEW
    one, zero = F.lit(1), F.lit(0)

    def parts_of(rows: DataFrame, name: str, grade: str) -> DataFrame:
        """rows with the number of parts of (list, grade)."""
        table = large.select("list", F.col("grade").alias(grade), F.col("parts").alias(name))
        return rows.join(F.broadcast(table) if few else table, ["list", grade], "left").withColumn(name, F.coalesce(name, one))

    own = parts_of(left, "parts", "grade").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    carried = ["node", "n", "place", "component", "earlier", *(["bits"] if bits is not None else [])]
    renamed = lambda s: [F.col(c).alias(f"{c}_{s}") for c in carried]
    # a part meets those of its own class and of the next one: the first side goes to each of them, the second comes from each
    x = own.select("list", "grade", "part", "parts", *carried, F.explode(F.array(zero, one)).alias("step")).withColumn("other", F.col("grade") + F.col("step"))
    x = parts_of(x, "others", "other").withColumn("with", F.explode(F.sequence(zero, F.col("others") - 1))).filter("step = 1 or part <= with")
    x = x.select("list", "grade", "part", "step", "with", *renamed("x"))
    y = own.select("list", F.col("grade").alias("other"), F.col("part").alias("with"), *carried, F.explode(F.array(zero, one)).alias("step")).withColumn("grade", F.col("other") - F.col("step"))
    y = parts_of(y, "others", "grade").withColumn("part", F.explode(F.sequence(zero, F.col("others") - 1))).filter("step = 1 or part <= with")
    y = y.select("list", "grade", "part", "step", "with", *renamed("y"))
    low, high, both = F.least("n_x", "n_y"), F.greatest("n_x", "n_y"), F.col("n_x") + F.col("n_y")
    rest = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    once = (F.col("step") == 1) | (F.col("part") < F.col("with")) | (F.col("node_x") < F.col("node_y"))
    close = once & (F.col("component_x") != F.col("component_y")) & (100 * low >= percent * high) & (rest >= _need(both, percent))
    first = F.size(F.array_intersect("earlier_x", "earlier_y")) == 0
    near = F.lit(True)
    if bits is not None:
        apart = sum(F.bit_count(F.col("bits_x")[k].bitwiseXOR(F.col("bits_y")[k])) for k in range(BITS // 64))
        near = both - apart >= 2 * _need(both, percent)
    met = x.join(y, ["list", "grade", "part", "step", "with"]).filter(close & first & near)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: one of each group of near duplicates, the one of its smallest doc_id.

    docs: doc_id, text; other columns stay as they are, also under names that differ in case alone. A group keeps one row, also where
    its smallest doc_id stands on several of its rows or on rows of other groups, which keep theirs. Texts without shingles (null, empty)
    are alike only where doc_ids are equal, too. Rows without doc_id all stay. An empty table gives an empty one.
    """
    names, at = docs.columns, {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text")}
    found, renamed = grouped(docs, size, percent)
    found = C.checkpointed(found)
    docs, own_id = docs.toDF(*[f"c{i}" for i in range(len(names))]), F.col(at["doc_id"])
    away = (F.col("doc_id") != F.col("component_id")).alias("away")
    ids = found.filter("doc_id is not null").select(F.col("doc_id").alias("gone_id"), away).groupBy("gone_id").agg(F.count("*").alias("times"), F.max("away").alias("away"))
    ids = C.checkpointed(ids.filter("times > 1 or away"))
    gone, twice = ids.select("gone_id"), ids.filter("times > 1").select("gone_id")
    few = {t: t.count() for t in (gone, twice)}
    one_of = lambda t: F.broadcast(t) if few[t] <= C.FEW else t
    kept = docs.join(one_of(gone), own_id == F.col("gone_id"), "left_anti")
    if not few[twice]:
        return kept.toDF(*names)
    staying = found.join(one_of(twice), F.col("doc_id") == F.col("gone_id"), "left_semi").filter(F.col("doc_id") == F.col("component_id"))
    staying = staying.groupBy("doc_id", "component").agg(F.min("node").alias("its_node")).select(F.col("doc_id").alias("its_id"), "its_node")
    again = with_node(docs.join(one_of(twice), own_id == F.col("gone_id"), "left_semi"), at["text"], size, renamed)
    again = again.join(staying, (own_id == F.col("its_id")) & F.col("own_node").eqNullSafe(F.col("its_node")), "left_semi")
    return kept.unionByName(again.dropDuplicates([at["doc_id"], "own_node"]).drop("own_node")).toDF(*names)


def with_node(docs: DataFrame, text: str, size: int, renamed: dict) -> DataFrame:
    """docs with own_node, the node of each row's set."""
    at = docs.columns.index(text)

    def run(batches):
        shingles = C.held(("shingles", size), lambda: Shingler(size))
        for batch in batches:
            nodes = [shingles.node(shingles(t), renamed) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "own_node"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("own_node", T.LongType())]))
