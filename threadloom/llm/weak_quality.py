"""Quality by weak supervision: heuristic labellers, their accuracies by expectation-maximisation, a hashed scorer.

Every document gets a vote (-1 poor, 0 none, 1 good) from each heuristic. Votes are counted by pattern over all
documents (at most 3 to the number of labellers), and EM on these counts estimates the share of good documents and each
labeller's vote probabilities under either class. The patterns' posteriors are the labels on which a logistic scorer
over hashed word shapes and shares is fitted, on at most `most` documents (by hash); it then scores every document.

Whole texts count, however long. A tie of the votes is decided by their accuracies; a quality of 0.5 is good. Null and
empty texts have no words: every labeller abstains but that for emptiness, which votes
poor. doc_id may be null or repeat; rows are judged one by one, repeated ones alike; other columns are carried along, one
named quality is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import CACHES, in_batches, tidied, written

MOST_SAMPLED = 20_000  # documents to fit the scorer on
BINS = 1 << 12

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = b"#$%&*|@^~<>{}=+_\\"
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _share(raw: bytes, of: bytes, whole: int) -> float:
    return (len(raw) - len(raw.translate(None, of))) / max(1, whole)


def measures(text: str | None) -> dict[str, float]:
    """What labellers and scorer look at."""
    raw = (text or "").encode()
    split = raw.split()
    n, lines = len(split), [x for x in raw.split(b"\n") if x.strip()]
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    return {
        "n": n,
        "adjacent": sum(map(eq, split, split[1:])) / max(1, n - 1),
        "distinct": len(set(split)) / max(1, n),
        "symbols": _share(raw, _SYMBOLS, len(raw)),
        "upper": _share(raw, _UPPER, letters),
        "bangs": _share(raw, b"!", n),
        "pipes": _share(raw, b"|", n),
        "letters": (letters + len(raw) - len(raw.translate(None, b"0123456789"))) / max(1, len(b"".join(split))),
        "wide": len(b"".join(split)) / max(1, n),
        "copies": 1 - len(set(lines)) / max(1, len(lines)),
        "lines": len(lines),
    }


def _vote(poor: bool, good: bool = False) -> int:
    return -1 if poor else int(good)


#: name -> vote from the measures; most know one kind of junk and abstain else
LABELLERS = {
    "empty": lambda m: _vote(m["n"] == 0),
    "adjacent repeats": lambda m: _vote(m["n"] > 20 and m["adjacent"] > 0.2),
    "few distinct words": lambda m: _vote(m["n"] > 40 and m["distinct"] < 0.25, m["n"] > 0 and m["distinct"] > (0.45 if m["n"] > 40 else 0.7)),
    "symbols": lambda m: _vote(m["symbols"] > 0.06),
    "symbols after words": lambda m: _vote(m["n"] > 10 and m["symbols"] * m["wide"] > 0.5),
    "capitals": lambda m: _vote(m["n"] > 10 and m["upper"] > 0.4),
    "exclamations": lambda m: _vote(m["n"] > 10 and m["bangs"] > 0.25),
    "table rests": lambda m: _vote(m["n"] > 10 and m["pipes"] > 0.15),
    "few letters": lambda m: _vote(m["n"] > 10 and m["letters"] < 0.75, m["letters"] > 0.78),
    "word length": lambda m: _vote(m["n"] > 10 and not 2 < m["wide"] < 15),
    "repeated lines": lambda m: _vote(m["lines"] > 4 and m["copies"] > 0.4),
}


def votes(m: dict[str, float]) -> int:
    """The votes as digits of one number to base 3, first labeller lowest."""
    code = 0
    for label in reversed(LABELLERS.values()):
        code = code * 3 + label(m) + 1
    return code


def _digits(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        out.append(code % 3)
        code //= 3
    return out


def estimate(counts: dict[int, int], steps: int = 200) -> tuple[float, np.ndarray, dict[int, float]]:
    """Share of good documents, vote probabilities (class, labeller, vote) and each pattern's posterior of good, by EM."""
    codes = sorted(counts)
    if not codes:
        return 1.0, np.zeros((2, len(LABELLERS), 3)), {}
    v, n = np.array([_digits(c) for c in codes]), np.array([counts[c] for c in codes], float)
    post = np.where((v == 0).any(1), 0.05, 0.95)  # at the start any poor vote decides
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    share, table = 0.5, np.zeros((2, len(LABELLERS), 3))
    for _ in range(steps):
        for c, weight in ((0, n * (1 - post)), (1, n * post)):
            table[c] = (np.einsum("i,ijk->jk", weight, one_hot) + 1) / (weight.sum() + 3)
        share = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        log = np.einsum("ijk,cjk->ci", one_hot, np.log(table))
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return share, table, dict(zip(codes, post.tolist(), strict=True))


class _Shapes(dict):
    """Hashed shape of a word: kinds of characters, runs of three or more cut to two."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        shape = word.translate(_SHAPE)
        if len(shape) > 3:
            kept = bytearray()
            for b in shape:
                if len(kept) < 2 or not kept[-1] == kept[-2] == b:
                    kept.append(b)
            shape = bytes(kept[:12])
        self[word] = h = xxhash.xxh32_intdigest(shape) % (BINS - 256)
        return h


_shapes = _Shapes()
CACHES.append(_shapes)


def features(text: str | None, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: shares of word shapes, and the measures cut to steps."""
    split = (text or "").encode().split()
    shapes = np.bincount(np.fromiter(map(_shapes.__getitem__, split), np.int64, len(split)), minlength=1) if split else np.zeros(1)
    at = np.flatnonzero(shapes)
    steps = [min(9, int(20 * m[k])) for k in ("adjacent", "symbols", "upper", "bangs", "pipes", "copies")] + [int(10 * m[k]) for k in ("distinct", "letters")]
    long = min(2, m["n"] // 20)
    marks = [BINS - 256 + xxhash.xxh32_intdigest(f"{i}:{x}:{long}") % 256 for i, x in enumerate(steps)] if split else [BINS - 1]
    scale = min(1.0, len(split) / 50) / max(1, len(split))  # shapes of a few words say little
    return np.concatenate([at, marks]), np.concatenate([shapes[at] * scale, np.ones(len(marks))])


@dataclass
class Model:
    good: float
    accuracies: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text, measures(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[at] @ x + self.bias, -700, 700))))


def fit(docs: DataFrame, most: int = MOST_SAMPLED) -> Model:
    """A model from the texts alone."""
    slim = docs.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    total = slim.count()
    below = 2**63 if total <= most else int(most / total * 2**64) - 2**63

    def judge(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = measures(text.as_py())
                at, x = features(text.as_py(), m) if h < below else (None, None)
                out.append((votes(m), None if at is None else at.tolist(), None if x is None else x.tolist()))
            code, at, x = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float64()))], names=["code", "bins", "x"])

    judged = written(in_batches(slim).mapInArrow(tidied(judge), "code long, bins array<int>, x array<double>"), "votes")
    counts = {r["code"]: r["count"] for r in judged.groupBy("code").count().collect()}
    share, table, post = estimate(counts)
    rows = judged.where("bins IS NOT NULL").collect()  # bounded: most documents, give or take the hash's chance
    owner = np.repeat(np.arange(len(rows)), [len(r["bins"]) for r in rows]) if rows else np.empty(0, int)
    at = np.array([b for r in rows for b in r["bins"]], np.int64)
    x = np.array([v for r in rows for v in r["x"]])
    y = np.array([post[r["code"]] for r in rows])
    w, bias = np.zeros(BINS), 0.0
    m, v, step_w = np.zeros(BINS + 1), np.zeros(BINS + 1), 0.05
    for step in range(1, 301 if rows else 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=w[at] * x, minlength=len(rows)) + bias, -30, 30)))
        g = np.append(np.bincount(at, weights=(p - y)[owner] * x, minlength=BINS) / len(rows) + 1e-4 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step_w * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - float(move[-1])
    right = {name: float((share * table[1, j, 2] + (1 - share) * table[0, j, 0]) / max(1e-9, share * table[1, j, [0, 2]].sum() + (1 - share) * table[0, j, [0, 2]].sum())) for j, name in enumerate(LABELLERS)}
    return Model(share, right, w, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality, in place of a column of that name: the scorer's probability that a document is good."""
    docs = docs.drop("quality")
    names = docs.columns
    at = names.index("text")

    def judge(batches):
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "quality"])

    return in_batches(docs).mapInArrow(tidied(judge), T.StructType([*docs.schema, T.StructField("quality", T.DoubleType())]))
