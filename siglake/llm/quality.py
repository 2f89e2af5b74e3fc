"""Quality by Bradley-Terry pairwise ranking.

Preference pairs are (a document labelled good, a document labelled bad). The score of a
document is linear in its features, and weights minimise the logistic loss of the features'
difference over the pairs. The threshold is a quantile of the scores of the labelled
documents: the share of bad ones among them (or the cut near it that errs least). Scores are
shifted and scaled so that the threshold becomes 0.7 on a scale from 0 to 1.

Weights come from a bounded sample of labelled rows (`sample`, the rows of least hash of the
id); features read whole texts, and every document is scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siglake.llm.common import column_of, mapped, pack, quoted, unpack

#: Most labelled rows that the weights are learned from, and pairs drawn among them.
SAMPLE, PAIRS = 20_000, 60_000
CUT = 0.7

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 sentence marks, 6 symbols, 7 pipe, 8 exclamation, 9 not ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[[ord(c) for c in "*#$%&@^~=+_<>[]{}\\/"]] = 6
_CLASS[ord("|")] = 7
_CLASS[ord("!")] = 8
_CLASS[128:] = 9
_TAG = re.compile(rb"https?://|www\.|<[a-z/]")


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms, from the whole text; an empty or null text has its own sign."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.array([1.0] + [0.0] * (WIDTH - 1))
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=10).astype(float)
    n, m = len(raw), len(words)
    letters = max(kinds[1] + kinds[2] + kinds[9], 1.0)
    low = raw.lower().split()
    counts = Counter(low)
    pairs = len(set(zip(low, low[1:], low[2:], strict=False)))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = Counter(_CLASS[w[-1]] for w in words)
    caps = sum(1 for w in words if len(w) > 1 and w.isupper())
    lone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    plain = len({re.sub(rb"[^A-Za-z\x80-\xff]+", b" ", x).strip().lower() for x in lines})
    base = [
        0.0, kinds[2] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[8] / n, kinds[9] / n,
        caps / m, lone / m, ends[6] / m, ends[8] / m, ends[5] / m, ends[3] / m,
        len(counts) / m ** 0.9, counts.most_common(1)[0][1] / m, 1 - pairs / max(m - 2, 1) if m > 2 else 0.0,
        1 - len(set(lines)) / max(len(lines), 1), 1 - plain / max(len(lines), 1),
        np.log1p(m) / 10, np.log1p(len(lines)) / 10, min(m / max(len(lines), 1), 200) / 200, min(n / m, 40) / 40, len(_TAG.findall(raw)) / m,
    ]
    sharp = [min(1.0, 10 * base[i]) for i in (1, 5, 6, 7, 9, 10, 11, 12, 17, 18)] + [float(m < k) for k in (4, 8, 16, 32)]
    return np.array(base + sharp)


WIDTH = 25 + 14


class Ranking:
    """Weights, and the shift and scale that put the threshold at CUT."""

    def __init__(self, weights, mean, scale, shift, slope):
        self.weights, self.mean, self.scale, self.shift, self.slope = weights, mean, scale, shift, slope

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.log(CUT / (1 - CUT)) + self.slope * (self.raw(x) - self.shift)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ranking(x: np.ndarray, good: np.ndarray, *, pairs: int = PAIRS, ridge: float = 1e-4, seed: int = 17) -> Ranking:
    """Bradley-Terry weights by gradient steps with momentum over pairs of a good and a bad row."""
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0) if len(x) else np.ones(WIDTH)
    z, w = (x - mean) / scale, np.zeros(WIDTH)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranking(w, mean, scale, -1.0 if len(up) else 1.0, 1.0)
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * len(x))
    left, right = z[rng.choice(up, n)], z[rng.choice(down, n)]
    diff = left - right
    speed = np.zeros(WIDTH)
    rate = 4.0 / max(np.linalg.norm(diff, axis=1).mean() ** 2 / WIDTH, 1e-9) / WIDTH
    for _ in range(400):
        loss = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        speed = 0.9 * speed + rate * (loss @ diff / n - ridge * w)
        w = w + speed
    raw = z @ w
    order = np.sort(raw)
    share = len(down) / len(raw)
    cuts = [np.quantile(order, q) for q in np.clip(share + np.linspace(-0.2, 0.2, 201) * min(share, 1 - share), 0, 1)]
    wrong = [max(np.mean(raw[good] < c), 0) * 0.5 + np.mean(raw[~good] >= c) * 0.5 for c in cuts]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    shift = (cuts[best[0]] + cuts[best[-1]]) / 2  # ties: the middle
    return Ranking(w, mean, scale, float(shift), float(2.0 / max(raw.std(), 1e-9)))


def learn_quality(docs: DataFrame, labels: DataFrame, keep: Column | None = None, *, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Ranking:
    """Ranking from labels(doc_id, quality) that keep admits. Null labels and ids teach nothing.

    Of repeated labels of an id the lower counts, of repeated documents of an id the one whose
    text has the least hash. Empty tables, or labels of one kind, give a ranking that predicts
    that kind (0 without any) for all. Ids are integers.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    if keep is not None:
        rows = rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded by sample, so it may be broadcast
    texts = docs.select(F.col(quoted(key)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").withColumn("t", F.xxhash64("text"))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "t": b["t"], "f": [features(t) for t in b["text"]]})

    got = mapped(found, measured, "doc_id long, quality int, t long, f array<double>")
    got = got.groupBy("doc_id").agg(F.min(F.struct("t", "quality", "f")).alias("x")).select("doc_id", "x.quality", "x.f").toPandas().sort_values("doc_id")  # sample rows at most
    x = np.array(got["f"].tolist()).reshape(-1, WIDTH)
    return fit_ranking(x, got["quality"].to_numpy() == 1)


def score_quality(docs: DataFrame, ranking: Ranking, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from CUT on).

    Nulls: a null text scores as an empty one. Repeated rows score alike. Texts are read whole.
    An empty table gives an empty result. Input columns named like an output column give way.
    """

    out = pack(docs, _scored(docs, ranking, text).alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
    return unpack(out, ["score", "predicted"])


def keep_good(docs: DataFrame, ranking: Ranking, *, text: str = "text") -> DataFrame:
    """The rows of docs that the ranking predicts to be good, with their columns as they were, whatever their names.

    A null text is judged as an empty one; repeated rows stand or fall together; an empty table
    stays empty.
    """
    return docs.where(_scored(docs, ranking, text) >= CUT)


def _scored(docs: DataFrame, ranking: Ranking, text: str) -> Column:
    kernel = lambda texts: pd.Series(ranking.score(np.array([features(t) for t in texts]).reshape(-1, WIDTH)))
    return column_of(docs.sparkSession, kernel, "double")(F.col(quoted(text)))
