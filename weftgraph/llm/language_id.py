"""Language identification with string kernels.

The kernel of two texts is the cosine of their sets of character n-grams of one to
four characters (a blended spectrum of presences, in a hashed table of a fixed
size). Nyström landmarks stand for the training texts; kernel ridge regression, one
language versus the rest, is solved over them. As the kernel is linear in the
presences, landmarks and solution fold into one matrix, and a batch of texts is
scored by one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
#: Bins of the n-gram table.
BINS = 1 << 15
ORDERS = 4
#: About so many training texts of each language are taken, by a hash of their id, and so many of them are landmarks.
PER_LANGUAGE, LANDMARKS = 300, 100
#: Landmarks of all languages together; beyond that each has an equal share.
MOST_LANDMARKS = 2000
#: Texts that share one matrix product.
BATCH = 128
UNKNOWN = "und"
#: Parts of the training texts that are left out in turn, and the share of their texts that may fall below the floor of firmness.
FOLDS, LOST = 5, 0.005

_letter = regex.compile(r"\p{L}").search
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _letter(text) is not None


def presences(text: str, row: np.ndarray) -> None:
    """Sets the bins of the text's n-grams to 1. Upper and lower case are one; what is not a letter in ASCII is a space."""
    for at in range(0, len(text), 1 << 20):  # a piece holds the first characters of the next, so no n-gram is lost
        codes = np.frombuffer(text[at : at + (1 << 20) + ORDERS - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)
        mixed = np.zeros(len(codes), np.uint32)
        for n in range(1, min(ORDERS, len(codes)) + 1):
            mixed = (mixed[: len(codes) - n + 1] * np.uint32(0x9E3779B1) ^ codes[n - 1 :]) * np.uint32(0x85EBCA6B)
            mixed ^= mixed >> np.uint32(15)
            row[(mixed + np.uint32(n * 0x27D4EB2F)) >> np.uint32(17)] = 1


class Kernel:
    """The kernel of training texts with the texts that may be landmarks. Presences stay packed; a block of them at a time is unpacked."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.languages = sorted({r[0] for r in rows})
        rows = sorted(rows)
        self.bits = np.array([np.frombuffer(r[1], np.uint8) for r in rows])
        self.of = np.array([self.languages.index(r[0]) for r in rows])
        self.each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(self.languages)))
        # with a part of the texts left out, the first landmarks of a language still are among so many
        self.pool = np.concatenate([np.flatnonzero(self.of == k)[: 2 * self.each] for k in range(len(self.languages))])
        z = self.presences(self.pool)
        self.values = np.concatenate([self.presences(np.arange(at, min(at + BATCH, len(rows)))) @ z.T for at in range(0, len(rows), BATCH)])

    def presences(self, at: np.ndarray) -> np.ndarray:
        x = np.unpackbits(self.bits[at], axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))

    def landmarks(self, texts: np.ndarray) -> np.ndarray:
        """Places in the pool of the landmarks when only the given texts are learned from."""
        known = np.isin(self.pool, texts)
        return np.concatenate([np.flatnonzero(known & (self.of[self.pool] == k))[: self.each] for k in range(len(self.languages))])

    def solved(self, texts: np.ndarray, marks: np.ndarray, ridge: float) -> np.ndarray:
        """Landmarks by languages: the ridge regression of one language versus the rest, in which each language weighs the same."""
        nm, of = self.values[np.ix_(texts, marks)].astype(np.float64), self.of[texts]
        mm = self.values[np.ix_(self.pool[marks], marks)].astype(np.float64)
        y = np.where(of[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        share = (1 / np.bincount(of, minlength=len(self.languages)).clip(1))[of]
        left = nm.T @ (share[:, None] * nm) + ridge * mm + 1e-9 * np.eye(len(mm))
        return np.linalg.solve(left, nm.T @ (share[:, None] * y))


def fit(rows: list[tuple[str, bytes]], ridge: float = 1e-3, kernel: Kernel | None = None) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of bins by languages) from (language, packed presences) of training texts, or their kernel."""
    if not rows:
        return [], np.zeros((BINS, 0), np.float32)
    kernel = kernel or Kernel(rows)
    every = np.arange(len(rows))
    marks = kernel.landmarks(every)
    w, matrix = kernel.solved(every, marks, ridge).astype(np.float32), np.zeros((BINS, len(kernel.languages)), np.float32)
    for at in range(0, len(marks), BATCH):
        matrix += kernel.presences(kernel.pool[marks[at : at + BATCH]]).T @ w[at : at + BATCH]
    return kernel.languages, matrix


def firmness(values: np.ndarray) -> np.ndarray:
    """The highest one-versus-rest value of each row plus its lead over the second (over -1, where there is one language).

    About 3 for a text like the training ones. One that shares nothing with them has values near 0 and no lead;
    one that shares a little of each language has values near 2 / languages - 1 and little lead.
    """
    ranked = np.sort(values, axis=1)
    return 2 * ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else -1.0)


def least_firmness(rows: list[tuple[str, bytes]], ridge: float = 1e-3, kernel: Kernel | None = None) -> float:
    """The firmness that all but LOST of the training texts reach, each by a model of the FOLDS - 1 parts it is not in; no bound from fewer than two texts."""
    if len(rows) < 2:
        return -np.inf
    kernel = kernel or Kernel(rows)
    part, values = np.arange(len(rows)) % FOLDS, np.zeros((len(rows), len(kernel.languages)))
    for k in range(min(FOLDS, len(rows))):
        own, rest = np.flatnonzero(part == k), np.flatnonzero(part != k)
        marks = kernel.landmarks(rest)
        values[own] = kernel.values[np.ix_(own, marks)].astype(np.float64) @ kernel.solved(rest, marks, ridge)
    return float(np.quantile(firmness(values), LOST, method="lower"))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def taught(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, packed presences) of the texts to learn from: rows with a language, a letter and crc32(doc_id as text) mod 3 other than 1.

    Their presences, not their texts, reach the driver: about PER_LANGUAGE rows of BINS bits for each language. Of several rows of one id, one is taken.
    """
    labelled = C.pick(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (remainder() != 1))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    lot, wanted = C.lot("doc_id"), F.lit(False)
    for lang, n in sorted(counts.items()):
        wanted = wanted | ((F.col("lang") == lang) & (lot < C.bound(PER_LANGUAGE, n)))
    # of several rows of one id, one
    chosen = labelled.filter(wanted).groupBy("doc_id").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("row")).select("row.text", "row.lang")

    def run(batches):
        for batch in batches:
            texts, langs = C.rows_of(batch, "text", "lang")
            out = []
            for text, lang in zip(texts, langs):
                if has_letter(text):
                    row = np.zeros(BINS, np.uint8)
                    presences(text, row)
                    out.append((lang, np.packbits(row).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.binary())], ["lang", "bits"])

    taken = chosen.mapInArrow(run, "lang string, bits binary").collect()
    return [(r["lang"], bytes(r["bits"])) for r in taken]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Learns from text and lang of docs."""
    return fit(taught(docs))


class Identifier:
    """(language, score, firmness) of texts by a trained model."""

    def __init__(self, model: tuple[list[str], np.ndarray]):
        self.languages, self.matrix = model
        self.x = np.zeros((BATCH, BINS), np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        found, scores, firm = [UNKNOWN] * len(texts), [0.0] * len(texts), [-np.inf] * len(texts)
        readable = [k for k, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for at in range(0, len(readable), BATCH):
            part = readable[at : at + BATCH]
            x = self.x[: len(part)]
            x[:] = 0
            for row, k in zip(x, part):
                presences(texts[k], row)
            values = x @ self.matrix / np.sqrt(x.sum(1, keepdims=True))
            for k, best, v, f in zip(part, values.argmax(1).tolist(), values, firmness(values).tolist()):
                found[k], scores[k], firm[k] = self.languages[best], min(1.0, max(0.0, (float(v[best]) + 1) / 2)), f
        return found, scores, firm


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of docs.

    docs: doc_id, text and, to learn from where no model is given, lang; other columns are
    ignored. lang_pred is ``und`` with score 0 where the text is null or has no letter, or where
    nothing could be learned; else the language of the highest one-versus-rest value v, with score
    (v + 1) / 2 within 0 and 1; the first by name among equals. held_out is false for a null doc_id.
    Repeated rows give repeated results; an empty table gives an empty one.
    """
    model = model or train(docs)

    def run(batches):
        C.let_go()
        of = Identifier(model)
        for batch in batches:
            ids, held, texts = C.rows_of(batch, "doc_id", "held_out", "text")
            found, scores, _ = of(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = C.pick(docs, "doc_id", "text").select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, T.StructType.fromDDL(SCHEMA))


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, least: float = 0.25, firm: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with a score of ``least`` or more and a firmness of ``firm`` or more.

    Without ``firm``, it is learned from docs (``least_firmness``), so that texts of no learned language go and
    all but about one in a hundred of the others stay. docs: doc_id, text, lang; other columns stay as they are, also under names that differ in case
    alone. Texts that are null or have no letter go; where nothing could be learned, all do. A row is judged by its text alone, so repeated rows
    stay or go together; an empty table gives an empty one.
    """
    rows = taught(docs) if model is None or firm is None else []
    kernel = Kernel(rows) if rows else None
    model = model or fit(rows, kernel=kernel)
    bound = least_firmness(rows, kernel=kernel) if firm is None else firm
    del rows, kernel
    C.let_go()  # on the driver
    at = docs.columns.index("text")

    def make():
        of = Identifier(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, scores, firmly = of(batch.column(at).to_pylist())
            return batch.filter(pa.array([f != UNKNOWN and s >= least and v >= bound for f, s, v in zip(found, scores, firmly)], pa.bool_()))

        return run

    return C.by_batch(docs, make)
