"""Best-fit packing of token sequences: minimum bin slack over the histogram of lengths.

Documents are tokenised, an end id is appended, and documents beyond the capacity are cut
into full pieces after a first piece that takes the remainder. Pieces of equal length are
interchangeable, so the packing is solved on the counts of the lengths 1 to capacity, which
the driver holds whatever the corpus: each bin takes the longest piece left and then the
combination that leaves the least slack, found by a subset-sum dynamic program over bitsets;
the combination is removed, as often as the counts allow at once. Every step uses up a length
or nearly so, hence the plan stays in the thousands of combinations. Pieces then find their
place from their rank among the pieces of their length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import binary_column
from factloom.llm.ranks import gapless
from factloom.llm.storage import bound_batches, materialize

#: Bytes of texts whose characters (ASCII and U+00C0 to U+027F) every Unicode table classes
#: alike; such texts get the same ids from the rank file, several times faster.
_PLAIN = np.zeros(256, bool)
_PLAIN[[9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_ENCODERS: dict[tuple[str, str], tuple] = {}


def _encoder(json_path: str, rank_path: str):
    """A function from text to its ids as the tokenizers file gives them, special strings
    included; a worker loads the files once."""
    if (json_path, rank_path) not in _ENCODERS:
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        fast = None
        if rank_path:
            import public_tokenizers
            import tiktoken

            with open(rank_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _ENCODERS[json_path, rank_path] = exact, fast
    exact, fast = _ENCODERS[json_path, rank_path]

    def encode(raw: bytes) -> np.ndarray:
        text = raw.decode("utf-8")
        if fast is not None and _PLAIN[np.frombuffer(raw, np.uint8)].all():
            return np.asarray(fast.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _pieces(json_path: str, rank_path: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(json_path, rank_path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, raw in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), binary_column(batch, "text"), strict=True):
                ids = np.append(encode(raw or b""), np.uint32(end_id)).astype("<u4")
                edge = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    part = ids[a:b].tobytes()
                    rows.append((doc, k, a, b - a, zlib.crc32(part), part))
                    held += len(part)
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The combination {length: how many} of largest sum up to ``capacity``."""
    reach, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(number of bins, {length: how many in each})], until no piece is left."""
    counts = {k: v for k, v in counts.items() if v}
    plan = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        bin_ = fullest(rest, capacity - longest)
        bin_[longest] = bin_.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in bin_.items())
        plan.append((times, bin_))
        for k, n in bin_.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return plan


def _places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, pieces a bin, first sequence and offset, by combination."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, bin_ in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            n = bin_[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += length * n
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def _place(places: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                first, each, base, shift = places[int(value)]
                k = np.searchsorted(first, rank[at], "right") - 1
                bin_, slot = np.divmod(rank[at] - first[k], each[k])
                sequence[at], offset[at] = base[k] + bin_, shift[k] + slot * value
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, json_path: str, rank_path: str = "", end_id: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id and
    offset, with the ids themselves (little-endian 32-bit) on demand.

    ``docs`` needs doc_id (long) and text; other columns are ignored. Null and empty texts are
    a piece of the end id alone. ``rank_path`` names the same vocabulary as ranks, used for
    plain texts only. Repeated rows are pieces of their own. Empty tables give empty results.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = docs.mapInArrow(_pieces(json_path, rank_path, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = materialize(pieces if keep_ids else pieces.drop("ids"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(minimum_bin_slack(counts, capacity))
    ranked = gapless(pieces, "length", ["doc_id", "piece"], "_rank", sum(counts.values()), len(counts))
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.select(*pieces.columns, "_rank").mapInArrow(_place(places), f"{schema}, sequence_id long, offset long")
