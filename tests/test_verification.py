import json
from datetime import date

import pytest

from factloom.functions import numbers, text
from factloom.operators import grounding as G
from factloom.operators import relational
from factloom.operators import verify as V
from factloom.sources import readers
from factloom.streaming.review import next_state


def found(quote, line):
    return [(m.found, m.strong, m.exact) for m in G.candidates(quote, [G.page_of(1, line)])]


def test_alignment():
    line = "Northwind NW-20260214 total $2,458.00. border 1,000"
    assert len(found("1", "Widget 1, 4.00 Gadget 1, 9.00")) == 2
    assert all(not found(q, line) for q in ("wind", "0214", "1", "58", "bor"))
    assert found("2,458.00", line) == [("2,458.00", True, True)]
    assert [s for _, s, _ in found("458.00", line)] == [False] and [s for _, s, _ in found("20260214", line)] == [False]
    assert found("final", "ﬁnal oﬃce") and found("office", "ﬁnal oﬃce") and not found("off", "ﬁnal oﬃce")


def test_ladder():
    assert found("5455", "Total 5.455") == [("5.455", True, False)]
    assert len(found("60000", "60.000 and 60.000")) == 2 and not found("5545", "5.455")
    assert found("2018-12-25", "on 25/12/2018") and not found("2018-12-26", "on 25/12/2018")
    assert [s for _, s, e in found("free ice tea", "FREE ICE TEA and Free Ice Tea") if not e] == [True, True]
    assert not found("WISMA HOME DECQ", "WISMA HOME DECO")[0][1] and not found("12.00", "12:00")[0][1] and not found("30,000", "total -30,000")[0][1]


@pytest.mark.parametrize("line, values", [("1e6", []), ("AB123CD", []), ("12:30", []), ("1/2", []), ("10²", []), ("½", []), ("(2)", ["-2"]), ("2x", ["2"]), ("2x3", []), ("Subtotal 18,182 - 15% DISC", ["18182"]), ("100.00 - $20.00", ["100.00", "-20.00"]), ("1 234,56", []), ("1\t234,56\n789,01", ["1", "234.56", "789.01"]), ("1x 234.56", ["1", "234.56"]), ("١٬٢٣٤٫٥٦", ["1234.56"]), ("٫٥٠", ["0.50"]), ("++100", []), ("(-100)", [])])
def test_number_tokens(line, values):
    assert [str(v) for t in numbers.tokens(line) for v, _ in t.readings()] == values


def test_number_check():
    ok = lambda v, e, s=None: numbers.check_number(v, e, s)[0]
    assert ok(9.0, "9.00") and not ok(9.01, "9.00") and ok(9.9999, "TOTAL 10.00")
    assert not ok(60, "TOTAL 60.000") and ok(60, "TOTAL 60.000", "decimal") and ok(60000, "TOTAL 60.000", "thousands")
    assert not ok(float("nan"), "1")


def test_dates():
    assert numbers.check_date("2026-03-14", "03/14/2026")[0] and numbers.check_date("2026-03-04", "March 4, 2026")[0]
    assert not numbers.check_date("2026-03-04", "03/04/2026")[0] and numbers.check_date("2026-04-03", "03/04/2026", "dmy")[0]
    assert not any(numbers.iso_date(x) for x in ("2026-03-04\n", "2026-3-4", "0000-01-01", "２０２６-03-04", "2026-W10-3", "2026-02-30"))
    assert numbers.iso_date("2024-02-29") == date(2024, 2, 29)


def test_strings_and_booleans():
    assert text.check_string("INV-1001", "Invoice Number: INV-1001")[0]
    assert not text.check_string("Northwind Traders", "Northwlnd Traders")[0] and text.check_string("Northwind Traders", "Northwlnd Traders", 1)[0]
    assert text.check_bool(True, "Approved: Yes.")[0] and not text.check_bool(True, "no changes: approval confirmed")[0]
    assert text.normalise(" a  “b”\n")[0] == 'a "b"'


def test_names():
    assert all(V.hints_date(p) for p in ("dueDate", "x.dateOfBirth", "ISSUE_DATE", "date2")) and not any(V.hints_date(p) for p in ("candidate_name", "updated_by", "validate_status"))
    assert V.row_prefix("items[0].amount") == "items[0]" and V.row_prefix("total") is None


def page(rows):
    words, at = [], 0
    for y, cells in rows:
        for x, said in cells:
            for w in said.split():
                words.append(G.Word(w, x, y, x + 6 * len(w), y + 10, at, at + len(w)))
                at += len(w) + 1
                x += 6 * len(w) + 4
    return G.Page(1, words)


def invoice():
    rows = [(0, [(0, "Description"), (150, "Qty"), (220, "Unit price"), (320, "Amount")])]
    rows += [(20, [(0, "Widget"), (150, "2"), (220, "5.00"), (320, "10.00")]), (40, [(0, "Gadget"), (150, "2"), (220, "7.00"), (320, "14.00")])]
    return page(rows)


def test_rows_and_columns():
    data = {"line_items": [{"description": {"value": "Gadget", "evidence": ["Gadget"]}, "quantity": {"value": 2, "evidence": ["2"]}, "unit_price": {"value": 7.0, "evidence": ["7.00"]}, "amount": {"value": 7.0, "evidence": ["7.00"]}}]}
    got = V.verify_document(V.flatten(data), [invoice()], V.Options(row_rules=V.INVOICE_RULES))
    assert [r.status for r in got] == ["verified", "verified", "verified", "needs_review"]
    assert [(r.row_status, r.column_status) for r in got[1:]] == [("same_line", "aligned"), ("same_line", "aligned"), ("same_line", "contradictory")]
    assert got[1].match.words[0].top == 40 and got[1].notes
    swapped = json.loads(json.dumps(data).replace('["7.00"]', '["5.00"]').replace("7.0", "5.0"))
    assert [r.row_status for r in V.verify_document(V.flatten(swapped), [invoice()], V.Options(row_rules=V.INVOICE_RULES))][2] == "separate"


def test_missing_and_ambiguous_evidence():
    pages = [G.page_of(1, "Total 5.00 and 5.00")]
    got = V.verify_document([V.Claim("a", 5.0, ["5.00"]), V.Claim("b", 5.0, []), V.Claim("c", "x", ["nowhere at all"])], pages)
    assert [r.status for r in got] == ["needs_review", "unsupported", "unsupported"] and got[0].match is None
    with pytest.raises(ValueError):
        V.flatten({"a": {"value": None, "evidence": []}})


def test_verify_on_tables(spark):
    words = spark.createDataFrame([(1, 1, i, w, 10.0 * i, 0.0, 10.0 * i + 9, 10.0, False) for i, w in enumerate("Total 2,666.93 due 14/03/2026".split())], "doc_id long, page int, word_no int, text string, x0 double, top double, x1 double, bottom double, review_paint boolean")
    claims = spark.createDataFrame([(1, 0, "total", "2666.93", ["2,666.93"], None, None), (1, 1, "due_date", '"2026-03-14"', ["14/03/2026"], 1, None), (2, 0, "total", "1", ["1"], None, None)], "doc_id long, field_no int, path string, value string, evidence array<string>, page int, declared_kind string")
    got = {(r.doc_id, r.path): r.status for r in V.verify(words, claims).collect()}
    assert got == {(1, "total"): "verified", (1, "due_date"): "verified", (2, "total"): "unsupported"}


def test_review_and_sinks():
    state = ("pending", None)
    for action, value in (("edit", "x"), ("approve", None)):
        state = next_state(*state, action, value)
    assert state == ("approved", "x") and next_state(*state, "reset", None) == ("pending", None)
    assert readers.open_archive(readers.pack_archive({"a.json": b"{}"})) == {"a.json": b"{}"}
    for bad in (b'{"a":1,"a":2}', b'{"a":NaN}', b"[]", b'{"a":"\\ud800"}'):
        with pytest.raises(ValueError):
            readers.read_strict(bad)
    assert readers.xlsx([{"a": 10**15, "b": 1.5}], ["a", "b"])[:2] == b"PK"


def test_containing_finds_long_short_and_blank_passages(spark):
    texts = ["one two three four", "xone two threex four", "a  b", "", None, "twofour", " "]
    quotes = ["one two three", "two thr", "ne", "o", " ", "  b", "", "four", None, "zz", "two four six"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    passages = spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string")
    got = sorted(map(tuple, relational.containing(docs, passages).collect()))
    assert got == [(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and q in t]


def test_nearest_candidate_always_chooses(spark):
    found = spark.createDataFrame([(1, 0, 2, 5.0), (1, 1, 1, 90.0), (1, 2, 1, 70.0), (2, 0, 3, 0.0)], "k long, ord long, page long, top double")
    hints = spark.createDataFrame([(1, 1, 80.0), (2, 1, 0.0)], "k long, page long, top double")
    assert sorted(map(tuple, relational.nearest_candidates(found, hints, "k").collect())) == [(1, 1, 1, 90.0), (2, 0, 3, 0.0)]


def test_report_stays_off_its_inputs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "total", "verified")], "doc_id long, path string, status string")
    source = tmp_path / "claims"
    rows.write.json(str(source))
    for bad in (source, source / "report", tmp_path):
        with pytest.raises(ValueError):
            readers.write_report(rows, str(bad), [str(source)])
    readers.write_report(rows, str(tmp_path / "claims-report"), [str(source)])
    assert spark.read.json(str(tmp_path / "claims-report")).count() == 1


def test_cell_intervals(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [("few%d" % k, d, "verified" if d < k else None) for k in range(5) for d in range(12)]
    rows += [("capped", 1, "verified"), ("capped", None, "no"), ("capped", None, "no"), (None, 1, "no")]
    rows += [("alike", d, s) for d in range(9) for s in ("verified", "no")]
    rows += [("mixed", d, rng.choice(["verified", "no", "no"] if d % 3 else ["verified"])) for d in range(60) for _ in range(rng.randint(1, 15))]
    df = spark.createDataFrame(rows, "cell string, doc int, status string")
    got = {r.cell: r for r in relational.cell_intervals(df, ["cell"], "doc", F.col("status") == "verified").collect()}
    for k, limit in enumerate((3.0, 4.74, 6.30, 7.75, 9.15)):
        r = got["few%d" % k]
        assert (r.n, r.k, r.docs, r.rate, r.lower_95, r.upper_95) == (12, k, 12, k / 12, None, min(1.0, limit / 12))
    assert (got["capped"].docs, got["capped"].upper_95, got[None].upper_95) == (2, 1.0, 1.0)
    assert (got["alike"].lower_95, got["alike"].upper_95) == (0.5, 0.5)
    per = {}
    for cell, d, s in rows:
        if cell == "mixed":
            n, k = per.get(d, (0, 0))
            per[d] = (n + 1, k + (s == "verified"))
    shares = []
    for _ in range(2000):
        drawn = rng.choices(list(per.values()), k=len(per))
        shares.append(sum(k for _, k in drawn) / sum(n for n, _ in drawn))
    shares.sort()
    m, wide = got["mixed"], shares[1949] - shares[50]
    assert abs(m.lower_95 - shares[50]) < 0.1 * wide and abs(m.upper_95 - shares[1949]) < 0.1 * wide


def test_many_small_documents_share_a_batch_and_no_slice_is_long(monkeypatch):
    """A batch a document, and each word an object of its own, was most of the time of a large table."""
    import pyarrow as pa

    class Gathered:
        def mapInArrow(self, run, ddl):
            return run

    word = {"page": 1, "word_no": 0, "text": "Total", "x0": 0.0, "top": 0.0, "x1": 5.0, "bottom": 10.0, "review_paint": False, "paint": None}
    words = [word, {**word, "word_no": 1, "text": "12.50", "x0": 6.0, "x1": 11.0, "paint": []}]
    claim = {"field_no": 0, "path": "total", "value": "12.5", "evidence": ["12.50"], "page": None, "declared_kind": None}
    n = 500
    said = [None if i % 5 == 4 else words for i in range(n)]
    told = [[claim, {**claim, "field_no": 1, "evidence": None if i % 2 else []}] for i in range(n)]
    fields = lambda of: pa.list_(pa.struct([(k, t) for k, t in of.items()]))
    w = fields({k: pa.string() if k == "text" else pa.bool_() if k == "review_paint" else pa.list_(pa.string()) if k == "paint" else pa.int64() if k == "word_no" else pa.int32() if k == "page" else pa.float64() for k in word})
    c = fields({k: pa.list_(pa.string()) if k == "evidence" else pa.int32() if k in ("field_no", "page") else pa.string() for k in claim})
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(said, w), pa.array(told, c)], names=["doc_id", "w", "c"])

    monkeypatch.setattr(V, "gathered", lambda words, claims: Gathered())
    run = V.verify(None, None)
    whole = list(run(iter([batch])))
    assert len(whole) == 1
    rows = whole[0].to_pylist()
    assert [(r["doc_id"], r["field_no"]) for r in rows] == [(i, k) for i in range(n) for k in (0, 1)]
    assert [r["status"] for r in rows] == [s for i in range(n) for s in ("unsupported" if i % 5 == 4 else "verified", "unsupported")]
    assert {r["found"] for r in rows if r["status"] == "verified"} == {"12.50"}
    # slices begin anywhere; one document may be longer than a slice
    for members in (1, 7, 100):
        monkeypatch.setattr(V, "SLICE_MEMBERS", members)
        parts = list(run(iter([batch.slice(3)])))
        assert len(parts) > 10 and [r for p in parts for r in p.to_pylist()] == rows[6:]


def test_windows_that_cannot_reach_the_least_score_are_not_compared(monkeypatch):
    from factloom.functions import text

    asked = []
    ratio = text.indel_ratio
    monkeypatch.setattr(text, "indel_ratio", lambda a, b: asked.append(b) or ratio(a, b))
    assert text.best_window("purchase number qq", "total 1,234.50 dated 03/04/1996", 70.0)[0] < 70.0 and not asked
    for short, long in (("invoice number", "the invoise number is 12"), ("abcdef", "xxabcxefxx"), ("abcd", "ab")):
        assert text.best_window(short, long, 60.0) == text.best_window(short, long)


def test_odd_blanks_of_plain_texts_keep_their_offsets():
    from factloom.functions.text import normalise

    for said in ("", " ", "a", "  a\t b\n\n", "\x1fa\x1c\x1d b ", "a a  a aa", "x y"):
        chars, source = normalise(said + "é")
        plain, offsets = normalise(said)
        cut = len(chars) - 1 - (said[-1:].isspace() and chars[-2:-1] == " ")
        assert (plain, offsets) == (chars[:cut], source[:cut])


def test_what_is_gathered_and_what_is_oversize_agree(spark, monkeypatch):
    for name, most in (("MAX_PAGES", 2), ("MAX_WORDS", 5), ("MAX_CHARS", 14)):
        monkeypatch.setattr(V, name, most)
    sizes = {1: [(1, "abc")], 2: [(1, "a"), (2, "b"), (3, "c")], 3: [(1, "a")] * 5, 4: [(1, "a")] * 6, 5: [(1, "x" * 14)], 6: [(1, "x" * 15)], 7: [(1, "x" * 7), (2, "x" * 7)], 8: [(1, "x" * 7), (1, "x" * 7)], 9: [(5, "a"), (9, "b")], 10: []}
    words = [(d, page, k, text, 0.0, 0.0, 1.0, 1.0, False) for d, said in sizes.items() for k, (page, text) in enumerate(said)]
    words = spark.createDataFrame(words, "doc_id long, page int, word_no long, text string, x0 double, top double, x1 double, bottom double, review_paint boolean")
    claims = spark.createDataFrame([(d, 0, "a", '"a"', ["a"], None, None) for d in sizes], "doc_id long, field_no int, path string, value string, evidence array<string>, page int, declared_kind string")
    over = {r.doc_id for r in V.oversize(words).collect()}
    got = {r.doc_id: [(w.page, w.text) for w in r.w or []] for r in V.gathered(words, claims).collect()}
    assert over == {2, 4, 6, 8} and got == {d: said for d, said in sizes.items() if d not in over}
