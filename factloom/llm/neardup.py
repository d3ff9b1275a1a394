"""Near-duplicate documents: b-bit MinHash signatures and a multi-index Hamming join.

Two documents are linked if the Jaccard similarity of their sets of word shingles reaches a
threshold; the groups are the connected components of the links.

1. Every set gets a signature of ``SYMBOLS`` MinHash values of which 8 bits each are kept.
   Documents with equal sets collapse to their smallest id before anything else, so a group
   of exact copies, however large, is one row from there on.
2. The signature is split into ``CHUNKS`` chunks of ``WIDTH`` symbols. By the pigeonhole
   principle two signatures that differ in at most ``REACH = 2 * CHUNKS - 1`` symbols have a
   chunk with at most one differing symbol. That error is enumerated: each chunk yields
   ``WIDTH`` keys, each with another symbol left out, and such a pair shares a key. At the
   default threshold of 0.8 a linked pair differs in 20 symbols of 100 in the mean; the reach
   of 39 is almost five standard deviations away (about 3 pairs in a million at similarity
   0.8 exactly, none to speak of at 0.83).
3. Within each key's rows, kernel A walks the graph of signature pairs within the reach and
   emits a spanning forest: linear in the rows, never all pairs. Its components are families
   that hold every pair within reach.
4. Kernel B takes a family's full texts and counts shared shingles exactly through an
   inverted index, again emitting a spanning forest, now of true links. Families beyond
   ``FAMILY_BLOCK`` rows or ``FAMILY_SHINGLES`` shingles are dealt by hash in as many blocks
   of half that as they need: first each block with some heads of the family, then, where
   several components remain, the rows outside the largest one against all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import U64, Words, binary_column, blocks, mix64
from factloom.llm.components import connected_components
from factloom.llm.storage import bound_batches, discard, materialize

SYMBOLS, CHUNKS, WIDTH = 100, 20, 5
REACH = 2 * CHUNKS - 1
#: Rows of one key, and rows and shingles of one family, that a single task takes together.
KEY_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES, HEADS = 1 << 16, 1024, 1 << 20, 16

_RNG = np.random.default_rng(77)
_XOR = _RNG.integers(0, 2**63, SYMBOLS).astype(U64)
_MUL = _RNG.integers(0, 2**63, SYMBOLS).astype(U64) | U64(1)


def shingle_sets(texts: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, ASCII letters lower-cased."""
    for _, run in blocks(texts):
        words = Words(run, lower=True)
        h = words.hashes()
        n = max(0, len(h) - size + 1)
        grams = np.zeros(n, U64)
        for k in range(size):
            grams = mix64(grams * U64(0xA24BAED4963EE407) + h[k : k + n])
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            elif b > a:  # fewer words than a shingle has: all of them as one
                whole = np.zeros(1, U64)
                for x in h[a:b]:
                    whole = mix64(whole * U64(0x9FB21C651E98DF25) + x + U64(1))
                yield whole
            else:
                yield np.empty(0, U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(shingles), 4096):
        x = (shingles[i : i + 4096, None] ^ _XOR) * _MUL
        np.minimum(low, (x ^ (x >> U64(29))).min(0), out=low)
    return (mix64(low) & U64(255)).astype(np.uint8)


def _signatures(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("print", pa.binary()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, sigs = [], [], []
            for s in shingle_sets(binary_column(batch, "text"), size):
                n.append(len(s))
                twice = mix64(s * U64(0xC2B2AE3D27D4EB4F))
                prints.append(np.array([np.bitwise_xor.reduce(mix64(s)), twice.sum(dtype=U64)], U64).tobytes() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    return run


def chunk_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys; each is exact: chunk, symbol left out, the other symbols."""
    parts = sigs.reshape(len(sigs), CHUNKS, WIDTH).astype(np.int64)
    out = np.empty((len(sigs), CHUNKS, WIDTH), np.int64)
    for skip in range(WIDTH):
        key = np.arange(CHUNKS)[None, :] * WIDTH + skip
        for k in range(WIDTH):
            if k != skip:
                key = (key << 8) | parts[:, :, k]
        out[:, :, skip] = key
    return out.reshape(len(sigs), -1)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            for i in range(0, len(sigs), 2000):
                keys = chunk_keys(sigs[i : i + 2000])
                ids = np.repeat(batch.column(0).to_numpy()[i : i + 2000], keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "node"])


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key: those of keys with two rows or more, with the place in the key."""
    last, place, held = None, 0, None

    def out(keys, nodes, places):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes), pa.array(places)], names=["key", "node", "place"])

    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        new = np.r_[keys[0] != last, keys[1:] != keys[:-1]]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        start = np.where(group >= 0, first[np.maximum(group, 0)] if len(first) else 0, 0)
        places = np.arange(len(keys)) - start
        places = np.where(group < 0, place + np.arange(len(keys)), places).astype(np.int64)
        more = np.r_[~new[1:], False]  # the next row has this key too
        keep = (places > 0) | more
        if held is not None and not new[0]:
            yield held
        held = None
        if not keep[-1]:
            held = out(keys[-1:], nodes[-1:], places[-1:])
        if keep.any():
            yield out(keys[keep], nodes[keep], places[keep])
        last, place = keys[-1], int(places[-1]) + 1


def _grouped(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        cut = np.zeros(batch.num_rows, bool)
        cut[0] = tuple(c[0] for c in cols) != last
        for c in cols:
            cut[1:] |= c[1:] != c[:-1]
        edges = np.r_[np.flatnonzero(cut), batch.num_rows]
        if edges[0] > 0 or not cut[0]:
            held.append(batch.slice(0, edges[0]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def reach_forest(nodes: np.ndarray, sigs: np.ndarray, reach: int = REACH) -> list[tuple[int, int]]:
    """Spanning forest of the pairs whose signatures differ in at most ``reach`` symbols.

    Breadth first; each node looks only at the nodes not yet reached, so a bucket that hangs
    together costs little more than one pass.
    """
    edges, left = [], np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (sigs[left] != sigs[at]).sum(1) <= reach
            edges += [(int(nodes[at]), int(nodes[x])) for x in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return edges


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _family_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for table in _grouped(batches, 2):
        nodes = table.column("node").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        out += reach_forest(nodes, sigs)
        if len(out) > 20_000:
            yield _edges(out)
            out = []
    if out:
        yield _edges(out)


def link_forest(nodes: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, known: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with 100 * shared >= percent * united, one of which asks.

    An inverted index of the sets gives each row's shared counts with all others exactly.
    ``known``: components found before; pairs inside one are skipped.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if sets else np.empty(0, U64)
    order = np.argsort(flat, kind="stable")
    value, who = flat[order], owner[order]
    begin = np.searchsorted(value, flat, "left")
    count = np.searchsorted(value, flat, "right") - begin
    offset = np.concatenate(([0], np.cumsum(sizes)))
    label = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(len(sets))
    edges = []
    for i in np.flatnonzero(asks & (sizes > 0)):
        if (label == label[i]).all():
            continue
        lo, n = begin[offset[i] : offset[i + 1]], count[offset[i] : offset[i + 1]]
        shared = np.zeros(len(sets), np.int64)
        step = max(1, int(4_000_000 // max(1, n.max())))
        for k in range(0, len(lo), step):
            a, b = lo[k : k + step], n[k : k + step]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(b)[:-1])), b) + np.arange(b.sum())
            shared += np.bincount(who[at], minlength=len(sets))
        hit = (100 * shared >= percent * (sizes + sizes[i] - shared)) & (label != label[i])
        while hit.any():
            j = int(np.argmax(hit))
            edges.append((int(nodes[i]), int(nodes[j])))
            label[label == label[j]] = label[i]
            hit &= label != label[i]
    return edges


def _true_edges(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            nodes = table.column("node").to_numpy()
            _, first = np.unique(nodes, return_index=True)
            table = table.take(first)
            known = table.column("known").to_numpy()
            found = link_forest(table.column("node").to_numpy(), list(shingle_sets(table.column("text").cast(pa.binary()).to_pylist(), size)), table.column("asks").to_numpy(zero_copy_only=False).astype(bool), known, percent)
            if found:
                yield _edges(found)

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id (long, unique) and text; other columns are ignored, whatever their
    names. Words are maximal runs of characters other than space and 0x09-0x0D, A-Z lowered.
    A document with fewer words than ``shingle_words`` has them all as its one shingle; null,
    empty and blank texts have no shingle, are linked with nothing and kept. component_id is
    the smallest doc_id reachable by links, kept says whether that is the document itself. A
    null doc_id takes no part in links and keeps a null component. Very long texts are taken
    whole. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(docs.mapInArrow(_signatures(shingle_words), "doc_id long, n_shingles long, print binary, sig binary"), "signatures")
    classes = materialize(signed.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "classes")

    keys = classes.select("node", "sig").mapInArrow(_emit_keys, "key long, node long")
    keys = keys.repartition("key").sortWithinPartitions("key", "node")
    keys = shared = materialize(keys.mapInArrow(_shared_keys, "key long, node long, place long"), "keys")
    large = keys.where(F.col("place") >= KEY_BLOCK).groupBy("key").agg(F.max("place").alias("top"))
    block = F.floor(F.col("place") / KEY_BLOCK).cast("int")
    top = F.coalesce(F.floor(F.col("top") / KEY_BLOCK).cast("int"), F.lit(0))
    placed = keys.join(large, "key", "left").select("key", "node", block.alias("at"), F.explode(F.sequence(F.lit(0), top)).alias("other"))
    placed = placed.select("key", (F.least("at", "other") * 1_000_000 + F.greatest("at", "other")).cast("long").alias("unit"), "node")
    placed = placed.join(classes.select("node", "sig"), "node").select("key", "unit", "node", "sig")
    forest = placed.repartition("key", "unit").sortWithinPartitions("key", "unit", "node").mapInArrow(_family_edges, "a long, b long")
    families = materialize(connected_components(forest), "families")
    discard(shared)
    family = materialize(families.select("node", F.col("component").alias("family")).join(classes.select("node", "n_shingles"), "node"), "members")
    discard(families)
    half = F.greatest(F.count("*") / (FAMILY_BLOCK // 2), F.sum("n_shingles") / (FAMILY_SHINGLES // 2))
    sizes = family.groupBy("family").agg(F.ceil(half).alias("blocks"))
    block = F.when(F.col("blocks") <= 2, 0).otherwise(1 + F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("long")
    placed = family.join(sizes, "family").select("family", "node", block.alias("block"))
    placed = materialize(placed, "blocks")
    discard(family)
    texts = placed.select("node").join(docs, placed.node == docs.doc_id).select("node", "text")
    texts = materialize(texts, "family-texts")

    def linked(rows: DataFrame) -> DataFrame:
        rows = rows.join(texts, "node").select("family", "block", "other", "node", "known", "asks", "text")
        rows = rows.repartition("family", "block", "other").sortWithinPartitions("family", "block", "other")
        return rows.mapInArrow(_true_edges(shingle_words, percent), "a long, b long")

    no = F.lit(0).cast("long")
    heads = placed.where("block > 0").groupBy("family").agg(F.expr(f"slice(array_sort(collect_set(case when block = 1 then node end)), 1, {HEADS})").alias("heads"))
    split = placed.where("block > 0").select("family", "block").distinct().join(heads, "family").select("family", F.explode("heads").alias("node"), "block")
    first = placed.select("family", "node", "block").unionByName(split).distinct().select("family", "block", no.alias("other"), "node", F.col("node").alias("known"), F.lit(True).alias("asks"))
    links = near = materialize(linked(first), "links")
    found = materialize(connected_components(links), "components")

    big = placed.where("block > 0").join(found, "node", "left").select("family", "block", "node", F.coalesce("component", "node").alias("known"))
    if not big.isEmpty():
        parts = big.groupBy("family", "known").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        big = big.join(parts.select("family", "main"), "family").withColumn("asks", F.col("known") != F.col("main"))
        askers = big.where("asks").select("family", "block").distinct()
        every = big.select("family", "block").distinct()
        pairs = askers.select("family", F.col("block").alias("x")).join(every.select("family", F.col("block").alias("y")), "family")
        side = pairs.join(big.where("asks").select("family", F.col("block").alias("x"), "node", "known"), ["family", "x"]).select("family", F.col("x").alias("block"), F.col("y").alias("other"), "node", "known", F.lit(True).alias("asks"))
        rest = pairs.where("x <> y").join(big.select("family", F.col("block").alias("y"), "node", "known"), ["family", "y"]).select("family", F.col("x").alias("block"), F.col("y").alias("other"), "node", "known", F.lit(False).alias("asks"))
        same = pairs.where("x = y").join(big.where("not asks").select("family", F.col("block").alias("y"), "node", "known"), ["family", "y"]).select("family", F.col("x").alias("block"), F.col("y").alias("other"), "node", "known", F.lit(False).alias("asks"))
        far = materialize(linked(side.unionByName(rest).unionByName(same)), "links")
        before, found = found, materialize(connected_components(links.unionByName(far)), "components")
        discard(far)
        discard(before)
    for table in (near, texts, placed):  # the result needs none of them
        discard(table)

    member = classes.select("print", "node").join(found, "node", "left").select("print", F.coalesce("component", "node").alias("class"))
    out = signed.join(member, "print", "left").select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
