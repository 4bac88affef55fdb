"""Merkle fingerprints of documents.

A text is cut, without losing a character, into sections, paragraphs and clauses. A section ends at a blank line or
at a paragraph chosen by its content; a paragraph at a line's end or, in long lines, at a clause chosen by its content. A paragraph's
digest covers its bytes, a section's its paragraphs' digests, and the root its sections'
digests and the length: equal roots tell equal texts. Where roots differ, the walk goes down the branches that differ: sections
that both have are skipped, then paragraphs in the others; what is left tells where the texts differ, and short digests of
its clauses measure how much they share.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, changed_start long, changed_end long"
#: Most bytes of a clause. About every so manyth paragraph ends a section, and every so manyth clause of a line a paragraph.
CLAUSE, SECTION, PARAGRAPH = 32, 16, 16

_CLAUSES = re.compile(rb"[^.!?,;:\n]{1,%d}[.!?,;:\n]{0,%d}|[.!?,;:\n]{1,%d}" % (CLAUSE, CLAUSE, CLAUSE)).findall
_CONTINUED = bytes(range(0x80, 0xC0))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


class Paragraph:
    """digest, n_chars, clauses as numbers of 24 bits."""

    __slots__ = ("digest", "n_chars", "clauses")

    def __init__(self, digest: bytes, n_chars: int, clauses: np.ndarray):
        self.digest, self.n_chars, self.clauses = digest, n_chars, clauses

    def __bytes__(self) -> bytes:
        low = np.ascontiguousarray(self.clauses.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
        return self.digest + self.n_chars.to_bytes(4, "little") + low.tobytes()

    @classmethod
    def parse(cls, raw: bytes) -> Paragraph:
        low = np.frombuffer(raw, np.uint8, offset=12).reshape(-1, 3)
        return cls(raw[:8], int.from_bytes(raw[8:12], "little"), np.pad(low, ((0, 0), (0, 1))).view("<u4").ravel())


class Tree:
    """root (hex) and sections, each a digest and its paragraphs."""

    def __init__(self, root: str, sections: list[tuple[bytes, list[Paragraph]]]):
        self.root, self.sections = root, sections

    @classmethod
    def of(cls, text: str) -> Tree:
        from xxhash import xxh32_intdigest

        raw, plain = text.encode("utf-8", "surrogatepass"), text.isascii()
        clauses = _CLAUSES(raw)
        marks = np.fromiter(map(xxh32_intdigest, clauses), np.uint32, len(clauses))
        ends = np.cumsum(np.fromiter(map(len, clauses), np.int64, len(clauses)))
        last = np.fromiter((c[-1] == 10 for c in clauses), bool, len(clauses)) | ((marks >> 24) % PARAGRAPH == 0)
        if len(last):
            last[-1] = True
        sections, paragraphs, begin, first = [], [], 0, 0
        for k in np.flatnonzero(last).tolist():
            end = int(ends[k])
            line = raw[begin:end]
            n = len(line) if plain else len(line.translate(None, _CONTINUED))
            paragraphs.append(Paragraph(_digest(line), n, marks[first : k + 1] & np.uint32(0xFFFFFF)))
            if line.endswith(b"\n\n") or paragraphs[-1].digest[0] % SECTION == 0:
                sections.append(paragraphs)
                paragraphs = []
            begin, first = end, k + 1
        if paragraphs:
            sections.append(paragraphs)
        sections = [(_digest(b"".join(p.digest for p in s)), s) for s in sections]
        root = hashlib.blake2b(b"".join(s[0] for s in sections) + len(raw).to_bytes(8, "little"), digest_size=16).hexdigest()
        return cls(root, sections)

    def __str__(self) -> str:
        return ":".join([self.root, *(",".join([d.hex(), *(base64.b64encode(bytes(p)).decode() for p in s)]) for d, s in self.sections)])

    @classmethod
    def parse(cls, text: str) -> Tree:
        root, *parts = text.split(":")
        sections = []
        for part in parts:
            digest, *paragraphs = part.split(",")
            sections.append((bytes.fromhex(digest), [Paragraph.parse(base64.b64decode(p)) for p in paragraphs]))
        return cls(root, sections)


def _tree(x: Tree | str) -> Tree:
    return Tree.parse(x) if isinstance(x, str) else x


def _unmatched(a: list, b: list, digest) -> tuple[list[int], list[int]]:
    """Places in a and in b of branches that the other does not have, counted with repeats."""
    rest: dict[bytes, int] = {}
    for x in b:
        rest[digest(x)] = rest.get(digest(x), 0) + 1
    mine = []
    for k, x in enumerate(a):
        if rest.get(digest(x), 0):
            rest[digest(x)] -= 1
        else:
            mine.append(k)
    theirs = []
    for k in reversed(range(len(b))):
        if rest[digest(b[k])]:
            rest[digest(b[k])] -= 1
            theirs.append(k)
    return mine, theirs[::-1]


def _walk(a: Tree, b: Tree) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) of a and of b that are left when the branches that both have are skipped, sections first."""
    sections = _unmatched(a.sections, b.sections, lambda s: s[0])
    left = [[(s, p) for s in at for p in range(len(t.sections[s][1]))] for t, at in zip((a, b), sections)]
    kept = _unmatched(*left_paragraphs(a, b, left), lambda p: p.digest)
    return [left[0][k] for k in kept[0]], [left[1][k] for k in kept[1]]


def left_paragraphs(a: Tree, b: Tree, left) -> tuple[list[Paragraph], list[Paragraph]]:
    return tuple([t.sections[s][1][p] for s, p in places] for t, places in zip((a, b), left))


def likeness(a: Tree | str, b: Tree | str) -> float:
    """The share of clauses, counted with repeats, that two fingerprints have in common: 1 for equal roots, 0 without a common clause.

    Branches that both have are taken whole; only the clauses of the others are compared.
    """
    return _compared(_tree(a), _tree(b))[0]


def _compared(a: Tree, b: Tree) -> tuple[float, list[tuple[int, int]]]:
    """(likeness, places in a that differ)."""
    if a.root == b.root:
        return 1.0, []
    mine, theirs = _walk(a, b)
    sizes = [sum(len(p.clauses) for _, s in t.sections for p in s) for t in (a, b)]
    if not sum(sizes):
        return 0.0, mine
    parts = [[p.clauses for p in x] for x in left_paragraphs(a, b, (mine, theirs))]
    same = sizes[0] - sum(map(len, parts[0]))
    if all(parts):
        values, counts = zip(*(np.unique(np.concatenate(x), return_counts=True) for x in parts))
        _, i, j = np.intersect1d(*values, assume_unique=True, return_indices=True)
        same += int(np.minimum(counts[0][i], counts[1][j]).sum())
    return 2 * same / sum(sizes), mine


def differing(a: Tree | str, b: Tree | str) -> list[tuple[int, int]]:
    """Stretches (start, end in characters) of the text of ``a`` whose paragraphs ``b`` does not have, joined where they touch."""
    a, b = _tree(a), _tree(b)
    return _stretches(a, _compared(a, b)[1])


def _stretches(a: Tree, places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    starts = np.concatenate(([0], np.cumsum([p.n_chars for _, s in a.sections for p in s]))).tolist()
    before = np.concatenate(([0], np.cumsum([len(s) for _, s in a.sections]))).tolist()
    at = [before[s] + p for s, p in places]
    runs = [[k for _, k in run] for _, run in groupby(enumerate(at), lambda x: x[1] - x[0])]
    return [(starts[run[0]], starts[run[-1] + 1]) for run in runs]


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many characters, or all, of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


#: Ranges of ids in a partition, on average; an id that seems to fill several ranges is cut by a hash of its texts.
RANGES = 4


def _ranges(docs: DataFrame, n: int) -> tuple[list[int], dict[int, int]]:
    """(bounds of about n equal ranges of doc_id, ids that fill several ranges with how many)."""
    found = docs.select("doc_id").dropna().approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    times: dict[int, int] = {}
    for x in found or []:
        times[int(x)] = times.get(int(x), 0) + 1
    hot = {x: k + 1 for x, k in times.items() if k > 1}
    return sorted({*times, *(x + 1 for x in hot)}), hot


def _range_of(bounds: list[int]):
    """The number of bounds up to doc_id, -1 for a null one; found in two steps, so that it takes the root of their number."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = math.isqrt(len(bounds)) + 1
    whole = F.array(*[F.lit(b) for b in bounds])
    first = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]), lambda b: b <= F.col("doc_id"))) * step
    return F.when(F.col("doc_id").isNull(), -1).otherwise(first + F.size(F.filter(F.slice(whole, first + 1, step), lambda b: b <= F.col("doc_id"))))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (part, borrowed, doc_id, text), dealt by part and sorted so that each document is followed by the next one by descending doc_id.

    A part is a range of ids, or of hashes of the texts of one id where that fills several ranges; the first document of each
    part is sent to the part above too (borrowed), and that of the highest to the lowest. Among equal ids, and among null ones, which come
    last, the order is by a hash of the text. Parts are dealt evenly to the partitions by their number.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    bounds, hot = _ranges(docs, RANGES * partitions)
    nulls = docs.filter("doc_id is null")
    if not nulls.isEmpty():
        hot[None] = RANGES * partitions
    cut = F.lit(0)  # the first texts of an id, by their hash, have the highest number, as they come first
    for x, k in hot.items():
        share = F.floor((tie.cast("double") / 2.0**64 + 0.5) * k)
        cut = F.when(F.col("doc_id").eqNullSafe(F.lit(x)), k - 1 - F.least(F.greatest(share, F.lit(0)), F.lit(k - 1))).otherwise(cut)
    most = max([1, *hot.values()])
    rows = docs.withColumn("part", _range_of(bounds) * F.lit(most).cast("long") + cut)
    heads = rows.groupBy("part").agg(F.max("doc_id").alias("id")).orderBy(F.desc("part")).collect()  # a row for each part; without texts, unless an id is cut
    if not heads:
        return rows.select("part", F.lit(False).alias("borrowed"), "doc_id", "text")
    to = [(h["part"], above["part"], h["id"]) for above, h in zip(heads, [*heads[1:], heads[0]])]
    targets = docs.sparkSession.createDataFrame(to, "of long, above long, of_id long")
    ids = [t[2] for t in to if t[2] is not None]
    near = rows.filter(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()) if ids else rows.filter("doc_id is null")
    near = near.join(F.broadcast(targets), (F.col("part") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    lent = near.groupBy(F.col("above").alias("part")).agg(F.min_by(F.struct("doc_id", "text"), tie).alias("first")).select("part", "first.*")
    every = rows.select("part", F.lit(False).alias("borrowed"), "doc_id", "text").unionByName(lent.select("part", F.lit(True).alias("borrowed"), "doc_id", "text"))
    to_partition = F.pmod(F.col("part"), F.lit(partitions)).cast("int")
    dealt = every.repartitionById(partitions, to_partition).sortWithinPartitions("part", "borrowed", F.desc_nulls_last("doc_id"), tie)
    return dealt.select("part", "borrowed", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint: a row for each row of docs (doc_id, text; null text: empty)."""

    def run(batches):
        for batch in batches:
            ids, texts = C.rows_of(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([str(Tree.of(t or "")) for t in texts], pa.string())], ["doc_id", "fingerprint"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, T.StructType.fromDDL("doc_id long, fingerprint string"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, changed_start, changed_end: a row for each row of docs.

    changed_start and changed_end, in characters of the text, hold all that the fingerprints show to be changed by the edit; null where nothing is.

    docs: doc_id, text; other columns are ignored. A null text is an empty one. The next document is that of the next
    lower doc_id (see with_next for equal and null ids); after the last comes the first, so a single document follows itself.
    An empty table gives an empty one.
    """

    def run(batches):
        before = None
        for batch in batches:
            out: list[tuple] = []
            for part, borrowed, key, text in zip(*C.rows_of(batch, "part", "borrowed", "doc_id", "text")):
                tree = Tree.of(text)
                if before is not None and before[0] == part:
                    out.append(_row(before, text, tree))
                before = None if borrowed else (part, key, text, tree)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            columns = [[r[i] for r in out] for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.name for f in schema])

    def _row(of, following: str, next_tree: Tree) -> tuple:
        _, key, text, tree = of
        changed = edited(text, following)
        changed_tree = Tree.of(changed)
        near, places = _compared(tree, changed_tree)
        where = _stretches(tree, places)
        span = (where[0][0], where[-1][1]) if where else (None, None)
        return key, len(text), hashlib.sha256(changed.encode()).hexdigest(), str(tree), str(changed_tree), near, likeness(tree, next_tree), *span

    schema = T.StructType.fromDDL(SCHEMA)
    return with_next(C.pick(docs, "doc_id", "text")).mapInArrow(run, schema)
