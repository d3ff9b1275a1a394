"""Repeated-passage removal: a positional collection BWT over passages aligned at anchors.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else,
in the same document or another. Matches never cross documents.

*Anchors.* Every ``length``-byte window picks, among the half-length grams inside it, the one
with the smallest hash (the leftmost of equals). Equal windows pick the same gram at the same
place, so windows can only be equal if their anchors hold equal grams: a gram that occurs once
settles all windows that picked it. This is lossless and leaves about two anchors per half
length. Equal texts are one text here, known by its digest; they are removed whole later.

*Construction.* Around every anchor whose gram occurs again, the bytes that its windows can
cover make one row, aligned at the gram. The rows of a gram are a collection of short
documents of which the suffix order is built column by column from the right: each round
inserts one symbol per document in front of its suffix, a stable distribution by symbol
gives the order of the longer suffixes, and the common prefix of neighbours is one more than
the smallest common prefix passed over. The symbols in suffix order are the collection's
Burrows-Wheeler transform; since equal windows stand in equal columns, the segment of each
round is compared within itself only, which makes the work linear in the text, and a round
needs nothing but the order and the common prefixes of the round before. A window is repeated
if a neighbour shares ``length`` symbols with it.

*Bounded groups.* A task takes few rows at a time, so a gram that stands in more than
``GROUP_ROWS`` places is split by the bytes beside it. The windows of a row begin at the columns
0 to half a length; those of the left half all hold the gram and the bytes before it up to the
middle, those of the right half the bytes after it. So each row goes into two groups of longer
grams, each for half of the windows, and again until groups are small or the gram is as long as
the window, where the rows of a group are equal and only counted. Equal rows of a batch settle
each other before they travel: one goes on, each is told its range. A passage that very many
texts share is thus a row a batch, and no group meets in one task. All of this is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import binary_column, prefix_hash, span_hash
from factloom.llm.neardup import _grouped
from factloom.llm.storage import bound_batches, discard, materialize

#: Places of a gram that one group may hold, and rows that one pass of the construction takes
#: together, over as many groups as that holds.
GROUP_ROWS = PASS_ROWS = 4096
#: Parts that the rows of a frequent gram are dealt in where they meet the list of such grams.
SALTS = 32
_PAD = 0xFF  # never a byte of UTF-8
_ROWS = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("print", pa.binary()), ("begin", pa.int64()), ("offset", pa.int32()), ("bytes", pa.binary()), ("stop", pa.int64())])
_ROWS_DDL = "key long, low int, print binary, begin long, offset int, bytes binary, stop long"
_SPANS_DDL = "print binary, start long, stop long"


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct positions of the leftmost minimum of every run of ``width`` values."""
    n = len(x)
    if n < width:
        return np.empty(0, np.int64)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    head = np.minimum.accumulate(rows, 1).ravel()
    low = np.minimum(tail[: n - width + 1], head[width - 1 : n])
    begin = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    end = np.r_[begin[1:], n - width + 1]  # windows begin..end - 1 share a minimum
    value = low[begin]
    spot = np.empty(len(begin), np.int64)
    for i in range(0, len(begin), 10_000):
        b = begin[i : i + 10_000]
        spot[i : i + 10_000] = b + (x[b[:, None] + np.arange(width)] == value[i : i + 10_000, None]).argmax(1)
    more = []
    for k in np.flatnonzero(spot + 1 < end):  # ties: windows past the first occurrence take the next
        at = begin[k] + np.flatnonzero(x[begin[k] : end[k] + width - 1] == value[k])
        more.append(at[1:][at[:-1] + 1 < end[k]])
    return np.unique(np.concatenate([spot, *more]))


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of a text's anchors; none if it is shorter than a window."""
    gram = length // 2
    n = len(text) - gram + 1
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    prefix = prefix_hash(np.frombuffer(text, np.uint8))
    at = np.arange(n)
    h = span_hash(prefix, at, at + gram)
    spots = sliding_argmin(h, length - gram + 1)
    return spots, h[spots].view(np.int64)


def _survey(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("print", pa.binary()), ("sha", pa.string()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in schema.names[1:]}
            for text in binary_column(batch, "text"):
                text = text or b""
                value, count = np.unique(anchors(text, length)[1], return_counts=True)
                sha = hashlib.sha256(text)
                rows["n_bytes"].append(len(text))
                rows["print"].append(sha.digest()[:16])
                rows["sha"].append(sha.hexdigest())
                rows["grams"].append(value)
                rows["places"].append(count)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id"))] + [pa.array(v, schema.field(k).type) for k, v in rows.items()], schema=schema)

    return run


class _Settling:
    """Rows of a batch on their way to their groups. Equal ones settle each other: the first goes
    on with its bytes, all are told the range that their windows cover. Ranges of one text that
    follow each other are told as one."""

    def __init__(self) -> None:
        self.seen: dict[tuple, tuple | None] = {}
        self.rows: list[tuple] = []
        self.open: list | None = None

    def tell(self, text: bytes, begin: int, stop: int) -> None:
        if self.open and self.open[0] == text and self.open[1] <= begin <= self.open[2]:
            self.open[2] = max(self.open[2], stop)
            return
        self.close()
        self.open = [text, begin, stop]

    def close(self) -> None:
        if self.open:
            text, begin, stop = self.open
            self.rows.append(((int.from_bytes(text[:7], "little") * 1_000_003 + begin) & 0x7FFFFFFFFFFFFFFF, 0, text, begin, 0, None, stop))
            self.open = None

    def put(self, key: int, low: int, text: bytes, begin: int, offset: int, part: bytes) -> None:
        same = key, offset, hashlib.blake2b(part, digest_size=16).digest()
        if same not in self.seen:
            self.seen[same] = text, begin
            self.rows.append((key, low, text, begin, offset, part, begin + len(part)))
            return
        first = self.seen[same]
        if first:
            self.tell(*first, first[1] + len(part))
            self.seen[same] = None
        self.tell(text, begin, begin + len(part))

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), _ROWS, strict=True)], schema=_ROWS)
            self.rows = []


def _contexts(length: int, which: str):
    """The rows of each text around the anchors whose grams its column ``which`` names."""
    slack = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Settling()
            prints = binary_column(batch, "print")
            wanted = batch.column(batch.schema.get_field_index(which)).to_pylist()
            for key, text, grams in zip(prints, binary_column(batch, "text"), wanted, strict=True):
                if not grams:
                    continue
                spots, h = anchors(text, length)
                keep = np.isin(h, np.array(grams, np.int64))
                for i, g in zip(spots[keep].tolist(), h[keep].tolist(), strict=True):
                    begin = max(0, i - slack)
                    out.put(g, 0, key, begin, slack - (i - begin), text[begin : i + length])
                    yield from out.batches(4000)
            out.close()
            yield from out.batches()

    return run


def halves(ranges: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Ranges (first, last) of window columns cut in two, by their first column; one of a single
    column stays."""
    return {a: [(a, b)] if a == b else [(a, (a + b) // 2), ((a + b) // 2 + 1, b)] for a, b in ranges}


def _split(length: int, into: dict[int, list[tuple[int, int]]]):
    """Each row once for each part of its range of windows in which it has a window: cropped to
    these windows, in the group of the bytes that all of them hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Settling()
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for key, low, text, begin, offset, part in zip(*cols, strict=True):
                left = low + offset
                right = left + len(part)
                for a, b in into[low]:
                    first, last = max(a, left), min(b, right - length)
                    if first > last:
                        continue
                    core = part[b - left : a + length - left]
                    inner = hashlib.blake2b(core + b"%d %d %d" % (key, a, b), digest_size=8).digest()
                    out.put(int.from_bytes(inner, "little", signed=True), a, text, begin + first - left, first - a, part[first - left : last + length - left])
                yield from out.batches(4000)
            out.close()
            yield from out.batches()

    return run


def insert_columns(group: np.ndarray, rows: list[bytes], offset: np.ndarray, length: int, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) column at which a row's window also stands in another row of its group,
    (-1, -1) for none. ``group`` must be sorted; row i begins at column ``offset[i]``; windows
    begin at the columns below ``windows``."""
    n, width = len(rows), windows - 1 + length
    first, last = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return first, last
    size = np.array([len(r) for r in rows])
    columns = np.full((width, n), _PAD, np.uint8)
    for i, r in enumerate(rows):
        columns[offset[i] : offset[i] + len(r), i] = np.frombuffer(r, np.uint8)
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)  # with the row before; the last one bounds ranges
    for j in range(width - 1, -1, -1):
        key = (group[order] << 8) | columns[j][order]
        put = np.argsort(key, kind="stable")
        key = key[put]
        same = np.flatnonzero(key[1:] == key[:-1])  # neighbours now that were p < q before
        fresh = np.zeros(n + 1, np.int32)
        if len(same):
            ends = np.empty(2 * len(same), np.int64)
            ends[0::2], ends[1::2] = put[same] + 1, put[same + 1] + 1
            fresh[same + 1] = 1 + np.minimum.reduceat(common, ends)[0::2] if j < width - 1 else 1
        order, common = order[put], fresh
        if j < windows:
            hit = common[:n] >= length
            hit[:-1] |= common[1:n] >= length
            who = order[hit]
            who = who[(j >= offset[who]) & (j + length <= offset[who] + size[who])]
            first[who] = j
            last[who] = np.where(last[who] < 0, j, last[who])
    return first, last


def _repeats(length: int, windows: int):
    schema = pa.schema([("print", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])

    def told(table: pa.Table) -> pa.RecordBatch:
        return table.select(["print", "begin", "stop"]).combine_chunks().rename_columns(schema.names).to_batches()[0]

    def settle(tables: list[pa.Table]) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(tables)), [t.num_rows for t in tables])
        table = pa.concat_tables(tables)
        offset = table.column("offset").to_numpy().astype(np.int64)
        first, last = insert_columns(group, table.column("bytes").to_pylist(), offset, length, windows)
        hit = first >= 0
        base = table.column("begin").to_numpy() - offset
        prints = table.column("print").filter(pa.array(hit)).combine_chunks()
        return pa.RecordBatch.from_arrays([prints, pa.array((base + first)[hit]), pa.array((base + last)[hit] + length)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in _grouped(batches, 1):
            if table.column("bytes").null_count:
                yield told(table.filter(pa.compute.is_null(table.column("bytes"))))
                table = table.filter(pa.compute.is_valid(table.column("bytes")))
            if table.num_rows < 2:
                continue
            held.append(table)
            n += table.num_rows
            if n >= PASS_ROWS:
                yield settle(held)
                held, n = [], 0
        if held:
            yield settle(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("print", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_bytes", pa.binary())])
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("print"))
        spans = batch.column(batch.schema.get_field_index("spans")).to_pylist()
        removed, count, sha, kept = [], [], [], []
        for text, found in zip(binary_column(batch, "text"), spans, strict=True):
            runs: list[list[int]] = []
            for a, b in sorted((s["start"], s["stop"]) for s in found):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            left = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)], strict=True))
            removed.append(len(text) - len(left))
            count.append(len(runs))
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        yield pa.RecordBatch.from_arrays([ids, pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], schema=schema)


def _among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` whose key is (``left_semi``) or isn't (``left_anti``) in ``keys``. A key may hold
    any share of the rows, so they are dealt in ``SALTS`` parts; the keys, few to the rows, go to
    each."""
    salted = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    part = F.pmod(F.xxhash64("print", "begin"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_salt", part).join(salted, ["key", "_salt"], how).drop("_salt")


def _built(rows: DataFrame, length: int, windows: int) -> DataFrame:
    """(print, start, stop) of repeated windows in the rows of groups that are small enough."""
    rows = rows.select(*_ROWS.names).repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_repeats(length, windows), _SPANS_DDL)


def _told(rows: DataFrame) -> DataFrame:
    return rows.where("bytes is null").select("print", F.col("begin").alias("start"), "stop")


def _frequent_spans(active: DataFrame, length: int, group_rows: int) -> list[DataFrame]:
    """Repeated ranges around the grams of too many places: their groups are split, all ranges of
    a level together, until each is small or holds one window a row."""
    rows = materialize(active.where("size(hot) > 0").mapInArrow(_contexts(length, "hot"), _ROWS_DDL), "frequent")
    found, ranges = [_told(rows)], [(0, length - length // 2)]
    rows = rows.where("bytes is not null")
    while any(a < b for a, b in ranges):
        into = halves(ranges)
        ranges = [x for parts in into.values() for x in parts]
        rows = materialize(rows.mapInArrow(_split(length, into), _ROWS_DDL), "split")
        found.append(_told(rows))
        rows = rows.where("bytes is not null")
        many = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("key"), "many")
        windows = max(b - a + 1 for a, b in ranges)
        if many.isEmpty():
            return [*found, _built(rows, length, windows)]
        found.append(_built(_among(rows, many, "left_anti"), length, windows))
        rows = materialize(_among(rows, many, "left_semi").select(*_ROWS.names), "frequent")
    # a row is one window now: of equal ones, all are repeated
    windows = rows.withColumn("key", F.xxhash64("bytes"))
    again = windows.groupBy("key", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    salted = again.select("key", F.col("bytes").alias("window"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    part = F.pmod(F.xxhash64("print", "begin"), F.lit(SALTS)).cast("int")
    met = windows.withColumn("_salt", part).join(salted, ["key", "_salt"]).where("bytes = window")
    return [*found, met.select("print", F.col("begin").alias("start"), "stop")]


def _analysed(docs: DataFrame, length: int, group_rows: int, keep_bytes: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of doc_id and text: every row with its sizes and digests (``print`` is that of its text),
    the texts with their copies, and the cuts of texts that lose bytes without having a copy."""
    if length < 4 or length % 2:
        raise ValueError("length must be even and at least 4")
    bound_batches(docs.sparkSession)
    surveyed = materialize(docs.mapInArrow(_survey(length), "doc_id long, n_bytes long, print binary, sha string, grams array<long>, places array<long>"), "survey")
    classes = materialize(surveyed.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.max("n_bytes").alias("size")), "texts")
    # one row of each text stands for all; rows that repeat a doc_id and its text all do, which
    # finds nothing more, as such texts are removed whole
    mine = lambda df: df.join(classes.where(F.col("size") >= length).select(F.col("print").alias("_print"), "node"), (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("node")), "left_semi")
    keys = mine(surveyed).select(F.explode(F.arrays_zip("grams", "places")).alias("g"), "print").select(F.col("g.grams").alias("key"), F.col("g.places").alias("n"), "print")
    counts = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "grams")
    is_hot = F.col("n") > group_rows
    wanted = keys.drop("n").join(counts, "key").groupBy("print").agg(F.collect_set(F.when(~is_hot, F.col("key"))).alias("grams"), F.collect_set(F.when(is_hot, F.col("key"))).alias("hot"))
    chosen = wanted.join(classes.select("print", "node"), "print")
    chosen = chosen.select(F.col("print").alias("_print"), "node", "grams", "hot")
    found = docs.withColumn("print", _print_of("text")).join(chosen, (F.col("print") == F.col("_print")) & F.col("doc_id").eqNullSafe(F.col("node")))
    active = materialize(found.select("print", "text", "grams", "hot"), "active")

    rows = active.mapInArrow(_contexts(length, "grams"), _ROWS_DDL)
    # ranges told travel with the rows, dealt by a number of their own, and pass the construction
    rows = rows.repartition("key").sortWithinPartitions("key")
    spans = rows.mapInArrow(_repeats(length, length - length // 2 + 1), _SPANS_DDL)
    if not counts.where(is_hot).isEmpty():
        for more in _frequent_spans(active, length, group_rows):
            spans = spans.unionByName(more)
    spans = spans.groupBy("print").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    single = classes.where("copies = 1").select("print")
    cut = active.select("print", "text").join(spans, "print").join(single, "print", "left_semi").mapInArrow(_cut, "print binary, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    cut = materialize(cut if keep_bytes else cut.drop("kept_bytes"), "cut")
    discard(active)
    discard(counts)
    return surveyed, classes, cut


def _print_of(text: str) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated_passages(docs: DataFrame, length: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    kept_sha256 (of the bytes left, lowercase hex).

    ``docs`` needs doc_id and text; other columns are ignored. doc_id is only passed through: it
    may be null or repeat, each row is judged by its text. Null text counts as empty. Every
    string is judged on the input. Texts shorter than ``length`` bytes lose nothing; equal texts
    of that length or more, a repeated row's included, lose everything, each copy alike. Bytes
    left need not be valid UTF-8. Very long texts are taken whole; empty tables give empty
    results. ``group_rows`` bounds the rows that meet in a task and does not change the result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    surveyed, classes, cut = _analysed(docs, length, group_rows, False)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    out = surveyed.drop("grams", "places").join(classes.select("print", "copies"), "print").join(cut, "print", "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = 200, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with kept_bytes, the bytes that ``repeated_passages`` leaves of each row's text;
    null where it loses none. All rows and columns stay, rows that repeat and null ids too; null
    texts lose nothing. ``docs`` is read twice and must give the same texts."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    _, classes, cut = _analysed(bare, length, group_rows, True)
    whole = classes.where((F.col("copies") > 1) & (F.col("size") >= length)).select("print", F.lit(b"").alias("kept_bytes"))
    gone = cut.select("print", "kept_bytes").unionByName(whole).withColumnRenamed("print", "_print")
    return docs.join(gone, _print_of("text") == F.col("_print"), "left").drop("_print")
