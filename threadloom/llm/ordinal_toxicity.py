"""Toxicity: cumulative-link ordinal regression of severity grades on sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all ordered thresholds; x marks which of the
selected hashed words a text holds. There are as many grades as the labels have (0 to the highest, MOST_GRADES at most):
binary labels give two, and then the expected severity is the probability of the higher one. Words are selected by exact
binomial tests of their documents' grades (above 0 or not) at a false discovery rate of ALPHA among all words that could
pass at all, after near copies among the labelled documents are counted once; a ridge holds down words that pass by few
documents. The model is fitted on at most `most` labelled documents (lowest hash of doc_id first) with at most MOST_WORDS
distinct words together (beyond that a share of them by hash); every document is scored, whole texts, however long.

Labels without doc_id or grade take no part, negative grades count as 0, of repeated ones the highest counts; documents
that repeat an id all take part, copies once. Null and empty texts hold no word and get the base severity; doc_id may be
null or repeat; other columns are carried along, those named severity, p_toxic or grade are replaced. Where the median
lies between two grades the higher is given. Without labels or without a significant word (some dozen labelled documents
can't show one) every severity is the base one, 0 if nothing is labelled. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import in_batches, tidied, written

MOST_LABELLED = 20_000  # labelled documents to fit on
MOST_WORDS = 20_000_000  # distinct words of these documents together, 4 bytes each on the driver
ALPHA = 0.05  # expected share of unrelated words among the selected
LEAST_DOCUMENTS = 3  # that hold a word which may be selected
MOST_GRADES = 10
PERMUTATIONS = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0x2545F491]

#: Bytes of words: ASCII letters (lower-cased), digits and whatever isn't ASCII; others part words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


@dataclass
class Model:
    weights: dict[int, float]  # by word hash
    thresholds: list[float]

    def severity(self, text: str | None) -> tuple[float, float, int]:
        """Expected grade, probability of a grade above 0, and the median grade."""
        score = sum(self.weights[h] for h in self.hits(text))
        above = [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]
        return math.fsum(above), above[0] if above else 0.0, sum(p >= 0.5 for p in above)

    def hits(self, text: str | None) -> list[int]:
        return sorted(h for h in map(xxhash.xxh32_intdigest, set(words(text))) if h in self.weights)


def _tail(n: int, k: int, p: float) -> float:
    """P(X >= k) for X binomial(n, p)."""
    if k <= n * p:
        return 1.0
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for i in range(k, n + 1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if term < total * 1e-12:
            break
    return total


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, ridge: float = 0.05, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by Adam on the penalised likelihood."""
    n, d = x.shape
    share = np.clip([(y >= k).mean() for k in range(1, grades)], 1e-4, 1 - 1e-4)
    first = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(first), 0.05))
    p = np.concatenate([np.zeros(d), first[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for step in range(1, steps + 1):
        w, t = p[:d], np.concatenate([p[d : d + 1], p[d] + np.cumsum(np.exp(p[d + 1 :]))])
        z = np.clip(t[None, :] - (x @ w)[:, None], -30, 30)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-z)), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        mass = np.maximum(below[rows, y + 1] - below[rows, y], 1e-12)
        up, down = slope[rows, y + 1] / mass, slope[rows, y] / mass
        by_w = (x.T @ (up - down) + ridge * w) / n  # z falls with the score
        by_t = np.zeros(grades - 1)
        np.add.at(by_t, np.minimum(y, grades - 2), np.where(y < grades - 1, -up, 0))
        np.add.at(by_t, np.maximum(y - 1, 0), np.where(y > 0, down, 0))
        by_t /= n
        by_gaps = np.array([by_t[k:].sum() * np.exp(p[d + k]) for k in range(1, grades - 1)])
        g = np.concatenate([by_w, [by_t.sum()], by_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:d], np.concatenate([p[d : d + 1], p[d] + np.cumsum(np.exp(p[d + 1 :]))])


def _hashed(batches):
    """Each text's distinct word hashes, and the lowest permuted hashes of its runs of three words."""
    for batch in batches:
        out, lows = [], []
        for text in batch.column(1):
            split = words(text.as_py())
            h = np.fromiter(map(xxhash.xxh32_intdigest, split), np.uint32, len(split))
            out.append(np.unique(h).tobytes())
            runs = h if len(h) < 3 else (h[:-2] * np.uint32(31) + h[1:-1]) * np.uint32(0x9E3779B1) + h[2:]
            runs = (runs ^ (runs >> np.uint32(16))) * np.uint32(0x7FEB352D)
            lows.append([int(((runs * np.uint32(a)) ^ ((runs * np.uint32(a)) >> np.uint32(15))).min()) for a in PERMUTATIONS] if len(runs) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(lows, pa.list_(pa.int64()))], names=["grade", "hashes", "lows"])


def significant(n: np.ndarray, k: np.ndarray, base: float, alpha: float = ALPHA) -> np.ndarray:
    """Which of the words, held by n documents of which k have a grade above 0, are selected: the step-up rule of
    Benjamini and Hochberg over all words of LEAST_DOCUMENTS documents."""
    tested = np.flatnonzero(n >= LEAST_DOCUMENTS)
    likely = tested[k[tested] > n[tested] * base]
    known: dict[tuple[int, int], float] = {}  # many words share their counts
    for pair in set(zip(n[likely].tolist(), k[likely].tolist(), strict=True)):
        known[pair] = _tail(*pair, base)
    p = np.array([known[pair] for pair in zip(n[likely].tolist(), k[likely].tolist(), strict=True)])
    order = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[order] <= alpha * np.arange(1, len(p) + 1) / max(1, len(tested)))
    return np.sort(likely[order[: passed[-1] + 1]]) if len(passed) else np.empty(0, np.int64)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from labels(doc_id, grade), grades 0, 1, 2, ..."""
    known = labels.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("grade", "text")
    hashed = in_batches(found).mapInArrow(tidied(_hashed), "grade int, hashes binary, lows array<bigint>").dropDuplicates(["grade", "hashes"])
    hashed = written(hashed, "labelled")
    size = (hashed.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) // 4
    if size > MOST_WORDS:
        hashed = hashed.where(F.pmod(F.xxhash64("hashes"), F.lit(1 << 20)) < int((1 << 20) * MOST_WORDS / size))
    seen: set[tuple[int, int]] = set()
    held: list[tuple[np.ndarray, int]] = []
    for r in hashed.orderBy("hashes", "grade").toLocalIterator():  # partition by partition
        h = np.frombuffer(r["hashes"], np.uint32)
        if not len(h):
            continue
        lows = list(enumerate(r["lows"]))  # near copies share most of them
        if sum(x in seen for x in lows) < 3:
            held.append((h, r["grade"]))
        seen.update(lows)
    seen.clear()
    if not held:
        return Model({}, [])
    y = np.clip([g for _, g in held], 0, MOST_GRADES - 1).astype(np.int64)
    grades, base = max(2, int(y.max()) + 1), (y > 0).mean()
    if base in (0.0, 1.0):
        return Model({}, [math.inf if base == 0 else -math.inf] + [math.inf] * (grades - 2))
    vocabulary, n = np.unique(np.concatenate([h for h, _ in held]), return_counts=True)
    above, k_above = np.unique(np.concatenate([h for h, g in held if g > 0]), return_counts=True)
    k = np.zeros(len(n), np.int64)
    k[np.searchsorted(vocabulary, above)] = k_above
    chosen = vocabulary[significant(n, k, float(base))]
    del vocabulary, above, n, k, k_above
    x = np.zeros((len(held), len(chosen)))
    for i, (h, _) in enumerate(held):
        x[i] = np.isin(chosen, h, assume_unique=True)
    w, t = fit_ordinal(x, y, grades)
    return Model({h: float(a) for h, a in zip(chosen.tolist(), w, strict=True)}, t.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with severity (expected grade), p_toxic and grade (median), in place of columns of these names."""
    docs = docs.drop("severity", "p_toxic", "grade")
    names = docs.columns
    at = names.index("text")

    def judge(batches):
        for batch in batches:
            found = [model.severity(t.as_py()) for t in batch.column(at)]
            cols = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, "severity", "p_toxic", "grade"])

    made = [T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType())]
    kind = T.StructType([*docs.schema, *made])
    return in_batches(docs).mapInArrow(tidied(judge), kind)
