"""Document quality by ordinal regression on graded ratings.

A rating has three grades: 0 for toxic text, 1 for poor and 2 for good text. One vector of
hashed-text weights gives each text a value f; ordered thresholds cut its line into
grades, P(grade <= k) = logistic(t_k - f). The expected grade and the probability of
the top grade decide what to select.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm import _common as C

SCHEMA = "doc_id long, expected_grade double, p_good double, selected boolean"
GRADES = 3
#: Bins of the hashed features.
BINS = 1 << 20
#: About so many rated texts of each grade are taken to learn from, by a hash of their id.
PER_GRADE = 4000
#: A bin counts only if, in some grade, its number of texts is so many deviations off what the grade's share of all words lets expect; others add noise.
UNEVEN = 5.0

_WORDS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_SYMBOL = bytes(i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;'-")


def _level(part: int, whole: int) -> int:
    """A share as one of a few levels, finer near zero."""
    return 0 if not part else min(6, 1 + int(np.searchsorted((0.01, 0.03, 0.1, 0.25, 0.5), part / max(whole, 1))))


def features(text: str) -> list[bytes]:
    """The distinct words of a text, their beginnings, and words that tell its make-up by levels."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().translate(_WORDS).split()
    found = set(words)
    n, distinct = len(raw), len(found)
    found |= {b"\1" + w[:4] for w in found} | {b"\2" + w[:5] for w in found if len(w) > 5}
    shares = {
        "upper": _level(n - len(raw.translate(None, _UPPER)), n),
        "digit": _level(n - len(raw.translate(None, _DIGIT)), n),
        "symbol": _level(n - len(raw.translate(None, _SYMBOL)), n),
        "repeat": int(8 * (1 - distinct / max(len(words), 1))),
        "length": len(words).bit_length() // 3,
    }
    return [*found, *(f"\0{k}:{v}".encode() for k, v in shares.items())]


def packed(text: str) -> bytes:
    """The text's bins, for fit."""
    return np.array(sorted(map(bin_of, features(text))), "<i4").tobytes()


def bin_of(word: bytes) -> int:
    return zlib.crc32(word) % BINS


def fit(rows: list[tuple[int, bytes]], rounds: int = 250, ridge: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights by bin, thresholds) from (grade, bins as bytes) of rated texts, by gradient steps on the likelihood.

    Each grade weighs the same. Without ratings all values are 0.
    """
    weights, cuts = np.zeros(BINS, np.float32), np.array([-1.0, 1.0])
    if not rows:
        return weights, cuts
    rows = sorted(rows)
    bins, n_rows = [np.frombuffer(r[1], "<i4") for r in rows], len(rows)
    grade = np.array([r[0] for r in rows])
    every, length = np.concatenate(bins), [len(b) for b in bins]
    del bins
    ends = np.concatenate(([0], np.cumsum(length)))[np.searchsorted(grade, np.arange(GRADES + 1))]  # rows are in the order of grades
    of_grade = np.stack([np.bincount(every[a:b], minlength=BINS) for a, b in zip(ends, ends[1:])])
    seen = of_grade.sum(0)
    due = seen * of_grade.sum(1, keepdims=True) / max(len(every), 1)
    uneven = np.abs(of_grade - due) / np.sqrt(due + 1)
    used = np.flatnonzero((seen >= 2) & (uneven.max(0) >= min(UNEVEN, 0.05 * n_rows)))
    place = np.full(BINS, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[every]
    del every, seen, of_grade, due, uneven
    kept = at >= 0
    doc, at = np.repeat(np.arange(n_rows, dtype=np.int32), length)[kept].astype(np.int64), at[kept].astype(np.int64)
    share = 1 / (np.bincount(grade, minlength=GRADES)[grade] * len(set(grade.tolist())))
    w, low, gap = np.zeros(len(used)), -1.0, np.log(2.0)
    moments = [np.zeros(len(used) + 2), np.zeros(len(used) + 2)]
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
    for step in range(1, rounds + 1):
        f = np.bincount(doc, w[at], n_rows)
        cuts = np.array([low, low + np.exp(gap)])
        upper = np.where(grade < 2, sigmoid(cuts[np.minimum(grade, 1)] - f), 1.0)
        lower = np.where(grade > 0, sigmoid(cuts[np.maximum(grade - 1, 0)] - f), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        up, down = upper * (1 - upper) / p * share, lower * (1 - lower) / p * share  # of the log likelihood by the cut above, below
        slope = up - down  # of the loss by f
        by_cut = [-(up[grade == k].sum()) + down[grade == k + 1].sum() for k in (0, 1)]
        g = np.concatenate((np.bincount(at, slope[doc], len(used)) + ridge * w / len(used), [by_cut[0] + by_cut[1], by_cut[1] * np.exp(gap)]))
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.05 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w -= move[:-2]
        low, gap = low - move[-2], gap - move[-1]
    weights[used] = w
    return weights, np.array([low, low + np.exp(gap)])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Learns from the labels' rows that have quality, toxic and a text; of several for one document, from the lowest grade.

    The bins, not the texts, of about PER_GRADE rows of each grade reach the driver. Of several texts of one id, one is taken.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rated = C.pick(labels, "doc_id", "quality", "toxic").dropna().select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    wanted = F.lit(False)
    for g, n in sorted(counts.items()):
        wanted = wanted | ((F.col("grade") == g) & (C.lot("doc_id") < C.bound(PER_GRADE, n)))

    def run(batches):
        for batch in batches:
            grades, texts = C.rows_of(batch, "grade", "text")
            bins = list(map(packed, texts))
            yield pa.RecordBatch.from_arrays([pa.array(grades, pa.int32()), pa.array(bins, pa.binary())], ["grade", "bins"])

    taken = F.broadcast(rated.filter(wanted))  # about GRADES * PER_GRADE ids
    rows = C.pick(docs, "doc_id", "text").filter(F.col("text").isNotNull()).join(taken, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")
    model = fit([(r["grade"], bytes(r["bins"])) for r in rows.mapInArrow(run, "grade int, bins binary").collect()])
    C.let_go()  # on the driver
    return model


class Weights(dict):
    """The weight of each word that was met."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        self[word] = v = float(self.weights[bin_of(word)])
        return v


#: Least probability of the top grade for a document to be selected. As each grade weighs the same in learning, that is below a half.
LEAST_GOOD = 0.35


class Grader:
    """(expected grade, probability of the top grade) of texts by a trained model."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray]):
        self.known, self.cuts = Weights(model[0]), model[1]

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        f, blank = np.zeros(len(texts)), np.array([not t or t.isspace() for t in texts], bool)
        for k, t in enumerate(texts):
            if not blank[k]:
                f[k] = sum(map(self.known.__getitem__, features(t)))
                if len(self.known) > C.WORDS_KEPT:
                    self.known.clear()
        above = [np.where(blank, 0.0, 1 / (1 + np.exp(np.clip(c - f, -30, 30)))) for c in self.cuts]
        return above[0] + above[1], above[1]


def grade_documents(docs: DataFrame, labels: DataFrame | None = None, model: tuple[np.ndarray, np.ndarray] | None = None, least: float = LEAST_GOOD) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_good (probability of the top grade), selected (p_good >= least): a row for each row of docs.

    docs: doc_id, text; labels, to learn from where no model is given: doc_id, quality, toxic;
    other columns are ignored. A text that is null or white space has grade and p_good 0. A null
    doc_id stays null; repeated rows give repeated results; an empty table gives an empty one.
    """
    model = model or train(docs, labels)

    def run(batches):
        C.let_go()
        of = Grader(model)
        for batch in batches:
            ids, texts = C.rows_of(batch, "doc_id", "text")
            grade, good = of(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grade), pa.array(good), pa.array(good >= least)], ["doc_id", "expected_grade", "p_good", "selected"])

    return C.pick(docs, "doc_id", "text").mapInArrow(run, T.StructType.fromDDL(SCHEMA))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, model: tuple[np.ndarray, np.ndarray] | None = None, least: float = LEAST_GOOD) -> DataFrame:
    """The selected rows of docs, with all their columns.

    docs: doc_id, text; other columns stay as they are, also under names that differ in case alone. Texts that are null or white space go (unless
    ``least`` is 0). A row is judged by its text alone, so repeated rows stay or go together; an empty table gives an empty one.
    """
    model = model or train(docs, labels)
    at = docs.columns.index("text")

    def make():
        of = Grader(model)
        return lambda batch: batch.filter(pa.array(of(batch.column(at).to_pylist())[1] >= least))

    return C.by_batch(docs, make)
