"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of 2 - 2c at most. After a
rotation to principal axes, the axes are split into blocks, and each block gets a part of that
distance in proportion to its share of the variance: a pair within the whole distance is
within the part of at least one block. Each block is range-joined by itself: strips along its
first axis, windows along its second, the budget over all of its axes. What the blocks hand on is checked
exactly on the given vectors, a pair only in the first block that finds it.

A page holds the vectors of a cell, whose sides are as long as the whole distance, along the two leading
axes; a cell that holds more becomes several pages. Each two pages of one cell or of neighbouring ones meet once, in
a task of their own, where all blocks are joined; a page meets itself without moving. Links are counted where they
are found; only a spanning forest of them leaves a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph.llm import _common as C
from weftgraph.llm.components import connected, forest

#: Axes of a block, bytes of a page, and vectors that the rotation is learned from.
BLOCK, PAGE_BYTES, SAMPLE = 8, 1 << 20, 4000
#: Rows that go through a block's windows together, and pairs that are checked together.
RUN, PAIRS = 256, 1 << 16
#: Pages of a cell are matched with one another in so many parts.
SALTS = 16
#: What rounding can take off a squared distance.
_SLACK = 1e-9


def rotation(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(orthogonal matrix, variance along each of its columns), the largest first."""
    values, axes = np.linalg.eigh(vectors.T @ vectors / max(len(vectors), 1))
    return np.ascontiguousarray(axes[:, ::-1]), np.maximum(values[::-1], 0)


def plan_blocks(variance: np.ndarray, radius2: float) -> list[tuple[int, int, float]]:
    """(first axis, end, squared-distance budget) of each block; the budgets add up to radius2."""
    cuts = list(range(0, len(variance), BLOCK))
    share = np.array([variance[a : a + BLOCK].sum() for a in cuts]) + 1e-3 * max(variance.sum(), 1e-12)
    return [(a, min(a + BLOCK, len(variance)), radius2 * s) for a, s in zip(cuts, share / share.sum())]


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled by their largest component first, so that no square is lost."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _within(x: np.ndarray, y: np.ndarray, block: tuple[int, int, float]) -> np.ndarray:
    """Whether rows are within the block's budget."""
    d = x[:, block[0] : block[1]] - y[:, block[0] : block[1]]
    return (d * d).sum(1) <= block[2] + _SLACK


class _Sorted:
    """Rows by strip along a block's first axis and, within a strip, along its second."""

    def __init__(self, r: np.ndarray, block: tuple[int, int, float], step: float):
        strip, along = np.floor(r[:, block[0]] / step), r[:, min(block[0] + 1, block[1] - 1)]
        self.order = np.lexsort((along, strip))
        self.strip, self.along = strip[self.order], along[self.order]

    def window(self, strip: float, low: float, high: float) -> np.ndarray:
        """Rows of a strip and its two neighbours whose second value is from low to high."""
        parts = []
        for s in (strip - 1, strip, strip + 1):
            a, b = np.searchsorted(self.strip, (s, s + 0.5))
            c, d = a + np.searchsorted(self.along[a:b], low), a + np.searchsorted(self.along[a:b], high, "right")
            parts.append(self.order[c:d])
        return np.concatenate(parts)


def range_join(rx: np.ndarray, ry: np.ndarray, block: tuple[int, int, float]):
    """(i, j) of rows, in parts, among them all pairs that are within the block's budget."""
    a, b, budget = block
    step = (budget + 2 * _SLACK) ** 0.5
    left, right = _Sorted(rx, block, step), _Sorted(ry, block, step)
    starts = np.flatnonzero(np.concatenate(([True], left.strip[1:] != left.strip[:-1])))
    for begin, end in zip(starts, [*starts[1:], len(rx)]):
        for at in range(begin, end, RUN):
            last = min(at + RUN, end)
            i, j = left.order[at:last], right.window(left.strip[at], left.along[at] - step, left.along[last - 1] + step)
            if len(j):
                p, q = rx[i, a:b], ry[j, a:b]
                near_i, near_j = np.nonzero((p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T <= budget + 2 * _SLACK)
                if len(near_i):
                    yield i[near_i], j[near_j]


def links(x: np.ndarray, y: np.ndarray, model, cosine: float, same: bool):
    """(i, j) of the rows of two pages whose cosine is enough, in parts, each pair once; of one page, i < j."""
    axes, blocks = model
    x, y = units(x), units(y)
    rx, ry = x @ axes, y @ axes
    for k, block in enumerate(blocks):
        for every_i, every_j in range_join(rx, ry, block):
            if same:
                every_i, every_j = every_i[every_i < every_j], every_j[every_i < every_j]
            for at in range(0, len(every_i), PAIRS):
                i, j = every_i[at : at + PAIRS], every_j[at : at + PAIRS]
                keep = _within(rx[i], ry[j], block)
                for earlier in blocks[:k]:
                    keep &= ~_within(rx[i], ry[j], earlier)
                i, j = i[keep], j[keep]
                keep = (x[i] * y[j]).sum(1) >= cosine
                if keep.any():
                    yield i[keep], j[keep]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors.

    vectors: vec_id (long), embedding (array of float or double), label; other columns are ignored. Rows link when their labels are
    equal and not null, their vectors equally long, and the cosine in double precision is at least ``cosine`` (above 0). Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing. n_links counts linked other rows, equal ones too;
    component_id is the smallest vec_id that links lead to; kept tells whether it is the row's own, so of rows with the same vec_id and
    component all or none. A null vec_id names a component only if it has no other. An empty table gives an empty one.
    Equal vectors of a label are found by two hashes of 64 bits.
    """
    rows = C.pick(vectors, "vec_id", "embedding", "label").withColumnRenamed("embedding", "vector")
    single = rows.schema["vector"].dataType.elementType == T.FloatType()
    kind, number = (np.float32, "float") if single else (np.float64, "double")
    rows = rows.withColumn("vector", F.col("vector").cast(f"array<{number}>"))
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    keys = ["key", "key_2"]
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", "label", "vector", "sound", F.xxhash64("label", "vector").alias("key"), F.xxhash64(F.lit("second"), "vector", "label").alias("key_2"))
    rows = C.checkpointed(rows)
    # equal vectors stand as one: rep is their number, many how many they are
    reps = rows.filter("sound").groupBy(*keys).agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
    reps = C.checkpointed(reps.withColumn("rep", F.monotonically_increasing_id()))
    radius2 = 2 - 2 * cosine
    models = {}
    for (width,) in [tuple(r) for r in reps.select(F.size("vector")).distinct().collect()]:  # the lengths of vectors: one, as a rule
        taken = reps.filter(F.size("vector") == width).orderBy(*keys).limit(SAMPLE).select("vector").collect()
        axes, variance = rotation(units(np.array([r[0] for r in taken])))
        models[width] = (axes, plan_blocks(variance, radius2))

    label = f"label {rows.schema['label'].dataType.simpleString()}"
    where = ["label", "width", "cell", "cell_2"]
    side = (radius2 + 4 * _SLACK) ** 0.5
    cells_schema = T.StructType.fromDDL(f"{label}, width int, cell long, cell_2 long, rep long, many long, vector array<{number}>")
    pages_schema = T.StructType.fromDDL(f"{label}, width int, cell long, cell_2 long, held binary")
    cells_arrow, pages_arrow = to_arrow_schema(cells_schema), to_arrow_schema(pages_schema)

    def placed(batches):
        """The cell of each vector along the two leading axes."""
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            width, cells = column.value_lengths().to_numpy(zero_copy_only=False), np.zeros((2, len(batch)), np.int64)
            for w in set(width.tolist()):
                at = np.flatnonzero(width == w)
                x = units(column.take(pa.array(at)).flatten().to_numpy().reshape(-1, w))
                for k in range(min(2, w)):
                    cells[k, at] = np.floor((x @ models[w][0][:, k]) / side)
            given = {n: batch.column(batch.schema.get_field_index(n)) for n in ("label", "rep", "many", "vector")}
            given |= {"width": pa.array(width, pa.int32()), "cell": pa.array(cells[0]), "cell_2": pa.array(cells[1])}
            yield pa.RecordBatch.from_arrays([given[f.name].cast(f.type) for f in cells_arrow], schema=cells_arrow)

    def paged(batches):
        """A row for each page; the rows come page by page."""
        at, held = None, []

        def page() -> pa.RecordBatch:
            blob = b"".join(h[c] for c in range(3) for h in held)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at[:4], blob), pages_arrow)], schema=pages_arrow)

        for batch in batches:
            key = list(zip(*C.rows_of(batch, *where, "part")))
            rep, many = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("rep", "many"))
            column = batch.column(batch.schema.get_field_index("vector"))
            cuts = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if key[a] != at and held:
                    yield page()
                    held = []
                at = key[a]
                held.append((rep[a:b].tobytes(), many[a:b].tobytes(), column.slice(a, b - a).flatten().to_numpy().tobytes()))
        if held:
            yield page()

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = C.checkpointed(reps.select("label", "rep", "many", "vector").mapInArrow(placed, cells_schema))
    room = F.greatest(F.lit(1), F.floor(F.lit(PAGE_BYTES) / (F.col("width") * np.dtype(kind).itemsize + 16)))
    large = C.checkpointed(cells.groupBy(*where).agg(F.count("*").alias("n")).filter(F.col("n") > room).select(*where, F.ceil(F.col("n") / room).alias("parts")))
    if large.count() <= C.FEW:
        large = F.broadcast(large)
    cells = cells.join(large, where, "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))))
    cells = cells.repartition(partitions, *where, "part").sortWithinPartitions(*where, "part", "rep").select(*where, "part", "rep", "many", "vector")
    pages = C.checkpointed(cells.mapInArrow(paged, pages_schema).withColumn("page", F.monotonically_increasing_id()))

    # two pages of a cell, or of cells that touch, meet once
    ahead = F.inline(F.array(*[F.struct(F.lit(a).alias("step"), F.lit(b).alias("step_2")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    left = pages.select(*where, F.col("page").alias("one"), ahead).withColumn("salt", F.pmod(F.xxhash64("one"), F.lit(SALTS)).cast("int"))
    left = left.withColumns({"cell": F.col("cell") + F.col("step"), "cell_2": F.col("cell_2") + F.col("step_2")})
    right = pages.select(*where, F.col("page").alias("two"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    meets = left.join(right, [*where, "salt"]).filter("step <> 0 or step_2 <> 0 or one < two").select("width", "one", "two")
    held = pages.select("page", "held")
    both = meets.join(held.select(F.col("page").alias("one"), F.col("held").alias("x")), "one").join(held.select(F.col("page").alias("two"), F.col("held").alias("y")), "two")
    alone = pages.select("width", F.col("held").alias("x"), F.lit(None).cast("binary").alias("y"))

    def unpacked(blob: bytes, width: int):
        size = np.dtype(kind).itemsize
        n = len(blob) // (16 + size * width)
        return np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.int64, n, 8 * n), np.frombuffer(blob, kind, n * width, 16 * n).reshape(n, width)

    def joined(batches):
        for batch in batches:
            for k in range(len(batch)):
                width, x, y = (batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("width", "x", "y"))
                same = y is None
                ids, many, x = unpacked(x, width)
                ids_y, many_y, y = (ids, many, x) if same else unpacked(y, width)
                counts, counts_y, ends = np.zeros(len(ids), np.int64), np.zeros(len(ids_y), np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
                for i, j in links(x, y, models[width], cosine, same):
                    np.add.at(counts, i, many_y[j])
                    np.add.at(counts_y, j, many[i])
                    ends = forest(*(np.concatenate(e) for e in zip(ends, (ids[i], ids_y[j]))))
                if not len(ends[0]):
                    continue
                counted = [(ids[counts > 0], counts[counts > 0]), (ids_y[counts_y > 0], counts_y[counts_y > 0])]
                a = np.concatenate([c[0] for c in counted] + [ends[0]])
                n = np.concatenate([c[1] for c in counted] + [np.zeros(len(ends[0]), np.int64)])
                b = pa.concat_arrays([pa.nulls(len(a) - len(ends[0]), pa.int64()), pa.array(ends[1])])
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

    found = both.select("width", "x", "y").unionByName(alone).mapInArrow(joined, T.StructType.fromDDL("a long, b long, n long"))
    found = C.checkpointed(found)
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    stars = connected(found.filter("b is not null").select("a", "b"))
    named = reps.select(*keys, "rep", "many", "least").join(stars.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    named = C.checkpointed(named.select(*keys, "many", "least", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    least = C.checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    by_key = C.checkpointed(C.looked_up(named, least, ["component"], "n").select(*keys, "many", "n_links", "component_id"))
    done = C.looked_up(rows.filter("sound").select("vec_id", *keys), by_key, keys, "many").select("vec_id", "n_links", "component_id")
    done = done.unionByName(rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
