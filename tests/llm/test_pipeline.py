"""The corpus pipeline on the smallest tables, stage by stage against brute force."""

import collections
import hashlib
import re

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from factloom.llm.storage import materialize, read

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, DIR, "documents")
    out = [("documents", docs)]
    for name, stage in P.STAGES:
        docs = materialize(stage(spark, docs, DIR), name)
        out.append((name, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_columns(stages):
    for _, df in stages[1:-1]:
        assert df.columns == stages[0][1].columns


def test_quality_drops_what_the_base_rules_fail(stages):
    before, after = texts(stages[0][1]), texts(stages[1][1])
    assert set(after) <= set(before) and after
    for i, text in before.items():
        w = words(text)
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        repeated = {k + d for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for d in range(3)}
        if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
            assert i not in after
        elif i in after:
            assert after[i] == text


def test_one_document_of_each_near_duplicate_group_stays(stages):
    before, after = texts(stages[1][1]), texts(stages[2][1])
    sets = {}
    for i, text in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                group[b] = a
    assert after == {i: before[i] for i in ids if top(i) == i}


def test_repeated_passages_go(stages):
    before, after = texts(stages[2][1]), texts(stages[3][1])
    assert set(before) == set(after)
    raw = {i: (t or "").encode() for i, t in before.items()}
    seen = collections.Counter(hash(b[k : k + 200]) for b in raw.values() for k in range(len(b) - 199))
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[hash(b[k : k + 200])] > 1:
                gone[k : k + 200] = b"\1" * 200
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert after[i] == left.decode(errors="ignore") or b == left and after[i] == before[i]


def test_redaction_keeps_documents(stages):
    before, after = texts(stages[3][1]), texts(stages[4][1])
    assert set(before) == set(after)
    assert {r.doc_id: r.n_chars for r in stages[4][1].collect()} == {i: len(t) for i, t in after.items() if t is not None} | {i: None for i, t in after.items() if t is None}


def test_packing_holds_every_token_once(stages):
    docs, pieces = texts(stages[4][1]), stages[5][1].collect()
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in docs.items()}
    held, placed = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        held[p.doc_id].append((p.piece, p.start, p.length))
        placed[p.sequence_id].append((p.offset, p.length))
    assert set(held) == set(want)
    for i, rows in held.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(rows)):
            assert (piece, start) == (k, at) and (length == 1024 or k in (0, len(rows) - 1))
            at += length
        assert at == want[i]
    for rows in placed.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024


def odd_documents(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.repartition(3)


def told(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=repr)


def wordy(seed, n=60):
    return " ".join(hashlib.sha256(f"{seed} {k}".encode()).hexdigest()[:6] for k in range(n))


def test_quality_judges_each_row(spark, monkeypatch):
    monkeypatch.setattr(P, "read", lambda *_: spark.createDataFrame([], "doc_id long, quality int"))
    good = [wordy(k) for k in range(3)]
    rows = [(None, good[0]), (None, "too short"), (7, good[1]), (7, "short too"), (7, good[1]), (8, None), (9, good[2])]
    out = P.quality_rules(spark, odd_documents(spark, rows), DIR)
    assert out.columns == P.COLUMNS
    assert told(out) == sorted(((i, t, len(t)) for i, t in rows if t in good), key=repr)


def test_near_duplicates_judges_each_row(spark):
    a, b, c, d = (wordy(k) for k in "abcd")
    rows = [(5, a), (5, a), (3, a + " more"), (None, b), (None, b), (None, c), (4, c), (6, d), (6, b + " other " + d), (None, None), (None, None), (8, "")]
    out = told(P.near_duplicates(spark, odd_documents(spark, rows), DIR))
    want = [(3, a + " more"), (None, b), (4, c), (6, d), (6, b + " other " + d), (None, None), (None, None), (8, "")]
    assert out == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=repr)


def test_repeated_passages_judges_each_row(spark):
    shared = wordy("s")[:250]
    rows = [(1, "A" + shared + "B"), (1, "C" + shared + "D"), (1, "alone"), (None, "E" + shared + "F"), (None, "none"), (2, None)]
    want = [(1, "AB"), (1, "CD"), (1, "alone"), (None, "EF"), (None, "none"), (2, None)]
    out = told(P.repeated_passages(spark, odd_documents(spark, rows), DIR))
    assert out == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=repr)


def test_secrets_and_packing_judge_each_row(spark):
    key = 'token = "aB3!xY7$kQ9#mN" '
    rows = [(5, key + wordy("a")), (5, key + wordy("a")), (None, key), (None, None), (6, ""), (7, wordy("long", 3000))]
    clean = P.secret_scan(spark, odd_documents(spark, rows), DIR)
    assert clean.columns == P.COLUMNS
    want = [(i, t if t is None else t.replace("aB3!xY7$kQ9#mN", "[SECRET]")) for i, t in rows]
    assert told(clean) == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=repr)
    pieces = P.best_fit_packing(spark, odd_documents(spark, rows), DIR).collect()
    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    held = collections.Counter()
    for p in pieces:
        held[p.doc_id] += p.length
    lengths = collections.Counter()
    for i, t in rows:
        lengths[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert held == lengths


def test_stages_take_empty_tables_and_further_columns(spark, monkeypatch):
    monkeypatch.setattr(P, "read", lambda *_: spark.createDataFrame([], "doc_id long, quality int"))
    docs = odd_documents(spark, [(1, wordy("a")), (2, wordy("b") + "\n" + wordy("c", 9000))])
    more = docs.selectExpr("*", "1 as kept", "'x' as component_id", "doc_id as _row", "text as _text", "0 as node", "0L as length")
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0
        out = stage(spark, more, DIR)
        assert {r.doc_id for r in out.collect()} == {1, 2}
        assert name == "best_fit_packing" or out.columns == P.COLUMNS


def test_packing_ids_are_those_of_the_library(spark):
    """Plain texts take their ids from the rank file: they must be the library's on real texts."""
    from factloom.llm import packing

    at = public_tokenizers.path
    library = Tokenizer.from_file(at("byte_bpe_50k.json"))
    encode = packing._encoder(at("byte_bpe_50k.json"), at("byte_bpe_50k.tiktoken"))
    for text in texts(read(spark, DIR, "documents")).values():
        if text is not None:
            assert encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_materialised_table_leaves_no_shuffle_behind(spark):
    """Left to the driver's garbage collection, a stage's shuffles were all on the disk at once."""
    import os

    from pyspark.sql import functions as F

    from factloom.llm import storage

    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for top in manager.localDirsString() for _, _, files in os.walk(top) for f in files if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key)
    rows = spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    rows = rows.join(spark.range(5).repartition(3, "id"), F.col("k") == F.col("id"))
    table = storage.materialize(rows, "swept")
    assert not shuffled() - before
    assert sorted((r.k, r["count"]) for r in table.collect()) == [(k, 100) for k in range(5)] and rows.count() == 5
    assert spark.conf.get(key) == setting


def test_near_duplicates_of_small_graphs_write_no_round_after_round(spark, monkeypatch):
    """A long chain of near copies: every table of a round costs the driver plans and tasks."""
    from factloom.llm import components

    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: written.append(name) or f(df, name))
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join([f"x{k}" for k in range(i)] + words[i:]) for i in range(0, 300, 8)]  # near up to three apart
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.near_duplicates(spark, docs, "").collect()] == [0]
    assert len(written) <= 4
