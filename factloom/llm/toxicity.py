"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Tokens (runs of letters, digits and non-ASCII bytes, lower-cased) are hashed into a fixed
number of buckets. A bucket's score is the log-odds of toxic against clean training rows with
an informative Dirichlet prior from the whole corpus (a text counts once for a bucket), as far as it stands above
its own standard error, less a constant drift; so chance texts score below zero a token. A
linear scan finds every maximal segment of positive sum. The scale of the segments' chance
distribution solves sum p * exp(scale * score) = 1 over the clean tokens; its location comes
from the largest segments of clean calibration rows, a quarter of the labelled ones that the
log-odds don't see. A text's evidence is the sum, over its
segments, of their scaled scores beyond what the best of its length reaches by chance; a
logistic curve fitted on the calibration rows turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import U64, Words, binary_column, blocks
from factloom.llm.linear import platt, sigmoid
from factloom.llm.storage import bound_batches

BUCKETS = 1 << 17
#: Weight of the prior in tokens; drift of a token; standard errors that a token must exceed.
PRIOR, DRIFT, ERRORS = 5000.0, 0.25, 2.0
#: One labelled row in so many, by a hash of doc_id, is kept from the log-odds for calibration.
CALIBRATION_SHARE = 4
#: Labelled rows that are used, at most, the smallest by a hash of doc_id; the bound is what
#: lets their ids be broadcast, so that no text is shuffled.
TRAIN_ROWS = 20_000
TOXIC_FROM = 0.7

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, lower=True, breaks=_BREAK)
    return (words.hashes() >> U64(64 - 17)).astype(np.int64), words.bounds


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of all, clean and toxic training rows that hold each bucket, one row a bucket."""
    total = np.zeros((3, BUCKETS), np.int64)
    for batch in batches:
        label = np.array([-1 if x is None else x for x in batch.column(batch.schema.get_field_index("label")).to_pylist()])
        for first, run in blocks(binary_column(batch, "text")):
            bucket, bounds = tokens(run)
            seen = np.unique(np.repeat(np.arange(len(run)), np.diff(bounds)) * BUCKETS + bucket)
            bucket, of = seen % BUCKETS, label[first + seen // BUCKETS]
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            for k in (0, 1):
                total[1 + k] += np.bincount(bucket[of == k], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[k][at]) for k in range(3))], names=["bucket", "every", "clean", "toxic"])


def log_odds(every: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Scores of the buckets, see the module's docstring."""
    prior = PRIOR * (every + 0.01) / (every.sum() + 0.01 * len(every))

    def odds(count: np.ndarray) -> np.ndarray:
        return np.log((count + prior) / (count.sum() + PRIOR - count - prior))

    delta = odds(toxic) - odds(clean)
    error = np.sqrt(1 / (toxic + prior) + 1 / (clean + prior))
    return np.sign(delta) * np.maximum(0, np.abs(delta) - ERRORS * error) - DRIFT


def chance_scale(score: np.ndarray, weight: np.ndarray) -> float:
    """The positive root of sum p * exp(x * score) = 1; 1 if no token scores above zero."""
    at = weight > 0
    s, p = score[at], weight[at] / max(1.0, weight[at].sum())
    if not len(s) or s.max() <= 0 or (p * s).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * s, 600))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 600))).sum() < 1 else (low, mid)
    return high


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (sum, first, stop), left to right, in linear time.

    Neighbours of one sign are taken as one step. Candidates form a chain: each remembers the
    nearest one before it that starts from a lower running sum.
    """
    up = score > 0
    if not up.any():
        return []
    edge = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
    stop = np.r_[edge[1:], len(score)]
    sums = np.add.reduceat(score, edge)
    total = np.concatenate(([0.0], np.cumsum(sums)))
    found: list[list] = []  # running sum before and after, first, stop, link
    for k in np.flatnonzero(sums > 0):
        low, high, first, last = total[k], total[k + 1], int(edge[k]), int(stop[k])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][0] >= low:
                j = found[j][4]
            if j < 0 or found[j][1] >= high:
                found.append([low, high, first, last, j])
                break
            low, first = found[j][0], found[j][2]
            link = found[j][4]
            del found[j:]
            j = link
    return [(float(b - a), i, k) for a, b, i, k, _ in found]


def _segment_sums(score: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = [], []
            for _, run_ in blocks(binary_column(batch, "text")):
                bucket, bounds = tokens(run_)
                s = score[bucket]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    n.append(int(b - a))
                    sums.append([x for x, _, _ in segments(s[a:b])])
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=[*names, "n_tokens", "sums"])

    return run


def evidence(n: int, sums: list[float], scale: float, location: float) -> float:
    beyond = scale * np.array(sums, float) - np.log(max(1, n)) - location
    return float(np.log1p(beyond[beyond > 0].sum()))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float, float]:
    """(bucket scores, scale, location, slope, shift); ``labels``: doc_id and label of the
    training rows alone, of which ``TRAIN_ROWS`` at most are used. The prior's counts cover all
    rows of ``docs``; the driver gets one row a bucket and the segment sums of the calibration rows.
    Where these lack a label, all rows serve both ends."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    labels = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    spare = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(CALIBRATION_SHARE)) == 0
    fitted, kept = labels.where(~spare), labels.where(spare)
    if kept.select("label").distinct().count() < 2:  # too few rows to keep some aside
        fitted = kept = labels
    told = docs.select("doc_id", "text").join(F.broadcast(fitted), "doc_id", "left").select("label", "text")
    counts = told.mapInArrow(_tally, "bucket long, every long, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    every, clean, toxic = np.zeros((3, BUCKETS))
    for to, name in ((every, "every"), (clean, "clean"), (toxic, "toxic")):
        to[counts["bucket"].to_numpy()] = counts[name]
    score = log_odds(every, clean, toxic)
    scale = chance_scale(score, clean)
    rows = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").select("label", "text")
    rows = rows.mapInArrow(_segment_sums(score), "label int, n_tokens long, sums array<double>").toPandas()
    best = np.array([scale * max(s) - np.log(max(1, n)) for n, s, y in zip(rows["n_tokens"], rows["sums"], rows["label"], strict=True) if not y and len(s)])
    location = float(best.mean() - np.euler_gamma) if len(best) else 0.0
    seen = np.array([evidence(n, s, scale, location) for n, s in zip(rows["n_tokens"], rows["sums"], strict=True)])
    return (score, scale, location, *platt(seen, rows["label"].to_numpy()))


def _judge(model: tuple[np.ndarray, float, float, float, float]):
    score, scale, location, slope, shift = model
    score = score.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _segment_sums(score)(batches):
            seen = np.array([evidence(n, s, scale, location) for n, s in zip(batch.column("n_tokens").to_pylist(), batch.column("sums").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(sigmoid(slope * seen + shift), pa.float64()), pa.array(seen, pa.float64())], names=["doc_id", "n_tokens", "score", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, score (probability of toxic), predicted
    (1 from ``TOXIC_FROM``) and evidence.

    Needs doc_id and text in ``docs`` and doc_id and label (1 toxic, 0 clean) of training rows
    in ``labels``; other columns are ignored. Null and empty texts have no evidence and the
    score that goes with it. Several labels of a document count as the highest. Whole texts
    are scanned. Without labels of both kinds no text is toxic. Empty tables give empty results.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    model = train(docs, labels)
    if model[3] == 1.0 and model[4] == 0.0:  # nothing to learn from
        model = (*model[:3], 0.0, -4.0)
    out = docs.mapInArrow(_judge(model), "doc_id long, n_tokens long, score double, evidence double")
    return out.select("doc_id", "n_tokens", "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def toxic_passages(docs: DataFrame, model: tuple[np.ndarray, float, float, float, float]) -> DataFrame:
    """Every significant segment of every text: doc_id, start and stop (bytes of its UTF-8),
    and beyond, its scaled score beyond chance. Texts without one have no row."""
    score, scale, location = model[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            rows: list[tuple] = []
            for first, run_ in blocks(binary_column(batch, "text")):
                words = Words(run_, lower=True, breaks=_BREAK)
                s = score[(words.hashes() >> U64(64 - 17)).astype(np.int64)]
                for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                    for total, u, v in segments(s[a:b]):
                        beyond = scale * total - np.log(max(1, b - a)) - location
                        if beyond > 0:
                            rows.append((ids[first + i], int(words.start[a + u] - words.offset[i]), int(words.end[a + v - 1] - words.offset[i]), float(beyond)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["doc_id", "start", "stop", "beyond"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, start long, stop long, beyond double")
