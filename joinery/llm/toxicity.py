"""Toxicity by cumulative-link ordinal regression (operator 10).

Severity grades are 0 (clean) to 3.  P(grade > k) = sigmoid(x . w - threshold[k]):
one weight vector for all thresholds, which are kept in order.  Reported are the
expected severity (the sum of the three probabilities), the most likely
grade, and ``toxic``: P(grade > 0) over 0.8, since clean documents should stay.

Features are hashed words and word beginnings of 3 to 7 bytes (so inflected forms share
weight), as log(1 + count).  ``labels`` says toxic or not; a toxic document's
training grade is 1 to 3 by thirds of its share of words that only toxic documents have.

The severity of training documents is thus told by words that the model reads too: the grades above 0
order toxic documents by how much of their text is such words, and claim no more.

The model is fitted on at most ``max_train`` labelled documents a class (the documented bound), those of the
smallest hash of doc_id.  Features whose class counts differ by more than ``MIN_GAP`` standard errors are
kept; they are counted and chosen in Spark, and only kept ones of the sampled documents come to the driver:
each document a list no longer than the fixed number of slots, however long its text.  Everything else covers all documents.

Defined results: null and empty texts have no features; without labels of both
classes all documents get severity 0; rows are judged one by one, so
repeated rows agree; a doc_id labelled twice is toxic if either label is; null
labels do not count; other columns are ignored, or kept by ``score``, which replaces those named like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import words as w

MAX_TRAIN, MIN_GAP, GRADES, TOXIC_OVER = 3000, 3.0, 4, 0.8
_SLOTS, _BEGIN = 1 << 20, (3, 4, 5, 6, 7)


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, w.Words]:
    """Text, word and slot of every feature."""
    text = w.words(data, offs, w.PLAIN, True)
    of, size = text.of(), text.ends - text.starts
    rows, which, slots = [of], [np.arange(len(of))], [(text.hashes >> np.uint64(44)).astype(np.int64)]
    if len(of):
        up, down = w._power(w._BASE, len(data) + 1)
        values = w._lower.astype(np.uint64)[data] + np.uint64(1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * up[: len(data)], out=sums[1:])
        for n in _BEGIN:
            long = np.flatnonzero(size > n)
            s = text.starts[long]
            h = w.mix((sums[s + n] - sums[s]) * down[s] + np.uint64(1000 + n))
            rows.append(of[long])
            which.append(long)
            slots.append((h >> np.uint64(44)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(which), np.concatenate(slots), text


@dataclass
class Model:
    slots: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """P(grade > k) by text and k."""
        rows, _, slots, _ = features(data, offs)
        z = np.zeros(len(offs) - 1)
        if len(self.slots) and len(rows):
            index = np.full(_SLOTS, -1, np.int32)
            index[self.slots] = np.arange(len(self.slots))
            f = index[slots]
            have = f >= 0
            pairs, n = np.unique(rows[have] * len(self.slots) + f[have], return_counts=True)
            z = np.bincount(pairs // len(self.slots), np.log1p(n) * self.weights[pairs % len(self.slots)], len(z))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    sides = [known.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in ("_toxic > 0", "_toxic <= 0")]
    # at most 2 * most rows of two numbers: a proven bound for the broadcast
    return docs.select("doc_id", "text").join(F.broadcast(sides[0].unionByName(sides[1])), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, min_gap: float = MIN_GAP) -> Model:
    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                rows, _, slots, _ = features(data, offs)
                key = np.unique(rows << 20 | slots)
                toxic = whole.column("_toxic").slice(lo, hi - lo).to_numpy(zero_copy_only=False)[key >> 20] > 0
                yield pa.RecordBatch.from_arrays([pa.array(key & (_SLOTS - 1), pa.int32()), pa.array(toxic)], names=["slot", "bad"])

    nothing = Model(np.empty(0, np.int64), np.empty(0), np.full(GRADES - 1, 40.0))
    own = common.materialise(_sample(docs, labels, max_train), "sample")
    size = {int(r.t): r.c for r in own.groupBy((F.col("_toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("c")).collect()}
    if len(size) < 2:
        return nothing
    df = own.mapInArrow(common.tidy(slots_of), "slot int, bad boolean").groupBy("slot").agg(F.count_if("bad").alias("d1"), F.count_if(~F.col("bad")).alias("d0"))
    p = (F.col("d0") + F.col("d1")) / (size[0] + size[1])
    gap = F.abs(F.col("d1") / size[1] - F.col("d0") / size[0]) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / size[0] + 1 / size[1]))
    chosen = df.filter((F.col("d0") + F.col("d1") >= 3) & (gap > min_gap)).orderBy("slot").collect()  # at most _SLOTS rows
    if not chosen:
        return nothing
    kept = np.array([r.slot for r in chosen], np.int64)
    index = np.full(_SLOTS, -1, np.int32)
    index[kept] = np.arange(len(kept))
    telling = np.array([r.d0 <= 0.02 * r.d1 for r in chosen])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                rows, which, slots, text = features(data, offs)
                f = index[slots]
                rows, which, f = rows[f >= 0], which[f >= 0], f[f >= 0].astype(np.int64)
                told = np.unique(which[telling[f]])  # words that tell, each once
                n = np.diff(text.first)
                share = np.bincount(text.of()[told], minlength=hi - lo) / np.maximum(n, 1)
                key, times = np.unique(rows << 20 | f, return_counts=True)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) << 20)
                pairs = [np.stack([key[a:b] & (_SLOTS - 1), times[a:b]]).astype("<u4").tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [whole.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), whole.column("_toxic").slice(lo, hi - lo).cast(pa.int32()), pa.array(share, pa.float64()), pa.array(pairs, pa.binary())],
                    names=["doc_id", "toxic", "share", "own"],
                )

    got = own.mapInArrow(common.tidy(narrow), "doc_id long, toxic int, share double, own binary").collect()
    common.drop(own)
    got = sorted(got, key=lambda r: (r.doc_id, r.toxic, r.share, r.own))  # the same model whatever order rows come in
    toxic, share = np.array([r.toxic > 0 for r in got]), np.array([r.share for r in got])
    cuts = np.quantile(share[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, share, side="left"), 0)
    pairs = [np.frombuffer(r.own, "<u4").reshape(2, -1) for r in got]
    row = np.repeat(np.arange(len(got)), [x.shape[1] for x in pairs])
    both = np.concatenate(pairs, 1).astype(np.int64)
    return _fit(row, both[0], np.log1p(both[1]), grade, kept)


def _fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, kept: np.ndarray, steps: int = 400, rate: float = 0.1, penalty: float = 3e-6) -> Model:
    """Adam on the mean log loss, clean and toxic documents weighing alike; thresholds are a first one and positive gaps."""
    n, k = len(grade), GRADES - 1
    toxic = grade > 0
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    params = np.concatenate([np.zeros(len(kept)), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(n)
    for step in range(1, steps + 1):
        weights, gaps = params[: len(kept)], np.exp(params[len(kept) + 1 :])
        t = params[len(kept)] + np.concatenate([[0], np.cumsum(gaps)])
        z = np.bincount(row, val * weights[col], n)
        over = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -40, 40)))
        full = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], 1)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))], 1)
        a, b = slope[at, grade] / p, slope[at, grade + 1] / p  # of the lower and the upper border
        dz = (b - a) * share
        dt = np.zeros(k + 2)
        np.add.at(dt, grade, a * share)
        np.add.at(dt, grade + 1, -b * share)
        dt = dt[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([np.bincount(col, val * dz[row], len(kept)) + penalty * weights, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(kept, params[: len(kept)], params[len(kept)] + np.concatenate([[0], np.cumsum(np.exp(params[len(kept) + 1 :]))]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with p_toxic, severity, grade and toxic, which replace columns of those names. No shuffle."""
    docs = docs.drop("p_toxic", "severity", "grade", "toxic")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi, data, offs in w.parts(whole.column("text")):
                over = model.score(data, offs)
                full = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], 1)
                grade = np.argmax(full[:, :-1] - full[:, 1:], 1)
                b = whole.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c) for c in names], pa.array(over[:, 0]), pa.array(over.sum(1)), pa.array(grade, pa.int32()), pa.array(over[:, 0] > TOXIC_OVER)],
                    names=[*names, "p_toxic", "severity", "grade", "toxic"],
                )

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(common.tidy(run), ", ".join([*kept, "p_toxic double, severity double, grade int, toxic boolean"]))


def grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", "grade", "severity", "p_toxic", "toxic")
