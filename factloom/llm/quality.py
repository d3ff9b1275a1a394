"""Quality rules: countable rules and a hashed n-gram classifier with calibrated verdicts.

The classifier is a logistic regression on the shares of hashed words (lower-cased) and of
hashed character trigrams and five-grams (bytes, case kept) in a text. It is trained on labelled rows,
calibrated on the quarter of them left out, and scored in Arrow batches: the score of a text
is a mean of looked-up weights, so no feature vector is built.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import U64, Words, binary_column, blocks, mix64, sum_by_text
from factloom.llm.linear import fit, platt, sigmoid
from factloom.llm.storage import bound_batches

#: Labelled rows that the classifier is fitted on, at most; chosen by a hash of doc_id.
TRAIN_ROWS = 2000
#: Rules: fewest words, and largest share of words in repeated three-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Calibrated probability of good quality from which a text is kept.
KEEP_FROM = 0.5

_BITS = 16
_FAMILIES = 3
WIDTH = _FAMILIES << _BITS
_SCALE = 100.0
#: Weights are scored as whole multiples of 1 / this.
_UNIT = 1 << 24
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = b" \t\n\x0b\x0c\r"


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: feature number of every occurrence, and the bounds of each text. Grams
    lie within one text each, so a text has the same features whatever stands beside it."""
    words = Words(texts, lower=True)
    out = [((words.hashes() >> U64(64 - _BITS)).astype(np.int64), words.bounds)]
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = words.offset[1:] - 1
    for family, n in ((1, 3), (2, 5)):
        code = np.zeros(max(0, len(buf) - n + 1), U64)
        for k in range(n):
            code = (code << U64(8)) | buf[k : k + len(code)]
        code = (code * U64(0x9E3779B97F4A7C15)) >> U64(64 - _BITS)
        size = np.maximum(0, ends - words.offset[:-1] - n + 1)
        edge = np.zeros(len(buf) + 1, np.int64)  # +1 where a text's grams begin, -1 after the last
        np.add.at(edge, words.offset[:-1], 1)
        np.add.at(edge, words.offset[:-1] + size, -1)
        inside = np.cumsum(edge[: len(code)]) > 0
        out.append((code[inside].astype(np.int64) + (family << _BITS), np.concatenate(([0], np.cumsum(size)))))
    return out


def counted_rules(texts: list[bytes]) -> dict[str, np.ndarray]:
    words = Words(texts)
    buf = words.buf
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=total[1:])
    points = total[words.end] - total[words.start]
    symbols = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_SYMBOL[buf], out=symbols[1:])
    h = words.hashes()
    who = words.text_of_word()
    grams = max(0, len(h) - 2)
    inside = who[:grams] == who[2:] if grams else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix64(mix64(mix64(h[at]) * U64(3) + h[at + 1]) * U64(5) + h[at + 2] + mix64(who[at].astype(U64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), np.int64)
    for k in range(3):
        covered[at[twice] + k] = 1
    dup = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(_WHITE)]
            dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": np.diff(words.bounds),
        "word_chars": sum_by_text(points, words.bounds),
        "n_symbols": symbols[words.offset[1:]] - symbols[words.offset[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": sum_by_text(covered, words.bounds),
    }


def _score(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores by ``weights`` in units of 1 / ``_UNIT``. The sums are of integers, hence exact: a
    text's score doesn't depend on its neighbours in the last bit either."""
    z = np.full(len(texts), bias)
    for feature, bounds in _features(texts):
        n = np.maximum(1, np.diff(bounds))
        z += _SCALE * (sum_by_text(weights[feature], bounds) / (n * _UNIT))
    return z


def _fixed_point(weights: np.ndarray) -> np.ndarray:
    return np.round(weights * _UNIT).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse features of labelled rows: columns and values as bytes."""
    for batch in batches:
        cols, values = [], []
        for _, run in blocks(binary_column(batch, "text")):
            found = _features(run)
            for i in range(len(run)):
                c, v = [], []
                for feature, bounds in found:
                    part = feature[bounds[i] : bounds[i + 1]]
                    value, count = np.unique(part, return_counts=True)
                    c.append(value)
                    v.append(_SCALE * count / max(1, len(part)))
                cols.append(np.concatenate(c).astype(np.int32).tobytes())
                values.append(np.concatenate(v).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("label")), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "cols", "values"])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, float, float]:
    """(weights, bias, slope, shift) from ``labels`` (doc_id, label 0/1) and the texts.

    At most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of doc_id, are used;
    their number bounds what reaches the driver. Without labels the model keeps everything.
    """
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    found = texts.select("doc_id", "label", "text").mapInArrow(_cells, "doc_id long, label int, cols binary, values binary")
    table = found.toPandas()  # TRAIN_ROWS documents at most, in any order
    if table.empty:
        return np.zeros(WIDTH), 4.0, 1.0, 0.0
    table = table.iloc[np.lexsort((table["values"], table["cols"], table["doc_id"]))].reset_index(drop=True)
    table = table.iloc[np.argsort(mix64(table["doc_id"].to_numpy().astype(U64)), kind="stable")].reset_index(drop=True)
    label = table["label"].to_numpy()
    fold = np.arange(len(table)) % 4 == 0
    cols = [np.frombuffer(x, np.int32) for x in table["cols"]]
    values = [np.frombuffer(x, np.float32) for x in table["values"]]

    def solve(take: np.ndarray) -> tuple[np.ndarray, float]:
        at = np.flatnonzero(take)
        rows = np.repeat(np.arange(len(at)), [len(cols[i]) for i in at])
        return fit(rows, np.concatenate([cols[i] for i in at]), np.concatenate([values[i] for i in at]), label[at], WIDTH, 1e-5)

    weights, bias = solve(~fold) if (~fold).any() else solve(fold)
    held = np.flatnonzero(fold)
    coarse = _fixed_point(weights) / _UNIT  # as texts are scored
    scores = np.array([bias + (coarse[cols[i]] * values[i].astype(float)).sum() for i in held])
    return (weights, bias, *platt(scores, label[held]))


def _judge(model: tuple[np.ndarray, float, float, float], keep_text: bool = False):
    weights, bias, slope, shift = model
    weights = _fixed_point(weights)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[str, list] = {n: [] for n in [*names, "probability"]}
            for _, texts in blocks(binary_column(batch, "text")):
                for n, x in counted_rules(texts).items():
                    parts[n].append(x)
                parts["probability"].append(sigmoid(slope * _score(texts, weights, bias) + shift))
            cols = {n: np.concatenate(x) if x else np.zeros(0) for n, x in parts.items()}
            held = [n for n in batch.schema.names if keep_text or n != "text"]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in held]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(cols[n].astype(np.int64)) for n in names), pa.array(cols["probability"].astype(np.float64))], names=[*held, *names, "probability"])

    return run


def quality(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and probability (calibrated, of good quality).

    Needs doc_id and text in ``docs`` and doc_id and label (1 good, 0 bad) in ``labels``;
    other columns are ignored. Null and empty texts have no words and fail the rules. Several
    labels of a document count as the highest. Repeated rows are judged alike; empty tables
    give empty results. Columns of ``docs`` named in ``carry`` stay beside each row's verdict.
    """
    bound_batches(docs.sparkSession)
    more = [c for c in carry if c not in ("doc_id", "text")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    model = train(docs, labels)
    held = docs if "text" in carry else docs.drop("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)
    out = docs.mapInArrow(_judge(model, "text" in carry), f"{schema}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("probability") >= KEEP_FROM)).alias("kept"), "probability", *(c for c in held.columns if c != "doc_id"))
