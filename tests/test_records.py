"""Archives, replay, rejects, paint, cells, audits, review streams and the command line."""

import json
import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from factloom import __main__ as command
from factloom.functions import text as T
from factloom.operators import audit as A
from factloom.operators import grounding as G
from factloom.operators import relational as R
from factloom.operators import study as S
from factloom.operators import verify as V
from factloom.sources import archives, readers
from factloom.streaming import review


def document(line, **paint):
    words, at = [], 0
    for i, w in enumerate(line.split()):
        words.append({"text": w, "bbox": {"x0": 40.0 * i, "top": 0.0, "x1": 40.0 * i + 30, "bottom": 10.0}, "start": at, "end": at + len(w), **(paint if i == 1 else {})})
        at += len(w) + 1
    return {"source": "x", "pages": [{"number": 1, "width": 600, "height": 800, "text": line, "words": words}]}


DATA = {"total": {"value": 12.5, "evidence": ["Total 12.50"], "page": 1}, "paid": {"value": True, "evidence": ["Paid: yes"], "page": None}}
PENDING = {p: {"status": "pending", "edited_value": None} for p in DATA}


def test_archive_recomputes_verdicts():
    line = "Total 12.50 Paid: yes"
    raw = archives.pack_review("a.pdf", document(line), DATA, {**PENDING, "total": {"status": "edited", "edited_value": 13}})
    back = archives.restore_review(raw)
    assert [r.status for r in back.results] == ["verified", "verified"] and back.review["total"] == ("edited", 13) and (back.name, back.text_mode) == ("a.pdf", "native")
    assert [r.status for r in archives.restore_review(archives.pack_review("a.pdf", document("Total 99.00 Paid: no"), DATA, PENDING)).results][0] != "verified"


@pytest.mark.parametrize("decisions", [
    {"total": PENDING["total"]}, {**PENDING, "more": PENDING["total"]}, {**PENDING, "total": {"status": "done", "edited_value": None}}, {**PENDING, "total": {"status": "edited", "edited_value": None}},
    {**PENDING, "total": {"status": "pending", "edited_value": 1}}, {**PENDING, "total": {"status": "edited", "edited_value": "1"}}, {**PENDING, "total": {"status": "edited", "edited_value": True}}, {**PENDING, "total": {"status": "edited", "edited_value": 10**400}},
    {**PENDING, "paid": {"status": "edited", "edited_value": 1}}, {**PENDING, "total": {"status": "pending"}}, {**PENDING, "total": {"status": "pending", "edited_value": None, "by": "x"}},
])
def test_archive_refuses_unsound_decisions(decisions):
    with pytest.raises(ValueError):
        archives.restore_review(archives.pack_review("a", document("Total 12.50"), DATA, decisions))


def test_archive_refuses_altered_members():
    raw = archives.pack_review("a", document("Total 12.50"), DATA, PENDING)
    def altered(change):
        out = BytesIO()
        with zipfile.ZipFile(BytesIO(raw)) as z, zipfile.ZipFile(out, "w") as to:
            for name in z.namelist():
                change(to, name, z.read(name))
        return out.getvalue()
    for change in (lambda to, n, b: to.writestr(n, b.replace(b"12.5", b"13.5")), lambda to, n, b: n != "review.json" and to.writestr(n, b), lambda to, n, b: to.writestr(n.replace("about", "other"), b)):
        with pytest.raises((ValueError, KeyError)):
            archives.restore_review(altered(change))
    for name in ("", "x" * 300):
        with pytest.raises(ValueError):
            archives.restore_review(archives.pack_review(name, document("Total 12.50"), DATA, PENDING))


@pytest.mark.parametrize("paint, kinds", [
    ({}, ()), ({"render_mode": 0, "raster_state": "contributes"}, ()), ({"render_mode": 3}, ("unpainted",)), ({"render_mode": 7, "zero_opacity": True}, ("unpainted", "transparent")), ({"clip_risk": True, "render_mode": 0}, ("clipped",)),
    ({"raster_state": "no_contribution"}, ("no_contribution",)), ({"raster_state": "ambiguous_overlap", "clip_risk": True}, ("clipped", "ambiguous_overlap")), ({"raster_state": "unavailable"}, ("unchecked",)), ({"render_mode": 0}, ("unchecked",)),
])
def test_paint_asks_for_review(spark, paint, kinds):
    doc = document("Total 12.50", **paint)
    assert G.paint_kinds(*(paint.get(k) for k in ("render_mode", "zero_opacity", "clip_risk", "raster_state"))) == kinds
    (got,) = V.verify_document([V.Claim("total", 12.5, ["Total 12.50"])], archives.pages_of(doc))
    assert got.reasons == [V.PAINT_REASONS[k] for k in kinds] and got.status == ("needs_review" if kinds else "verified")
    row = readers.document_words(spark.createDataFrame([(1, json.dumps(doc))], "doc_id long, json string")).where("word_no = 1").first()
    assert tuple(row.paint) == kinds and row.review_paint == bool(kinds)


def test_hidden_words_settle_no_convention():
    doc = document("x 1,234.50 TOTAL 60.000", render_mode=3)
    (got,) = V.verify_document([V.Claim("total", 60.0, ["TOTAL 60.000"])], archives.pages_of(doc))
    assert got.status == "needs_review"


def test_cells():
    sheet = zipfile.ZipFile(BytesIO(readers.xlsx([{"a": "_x0041_ & <b>\r", "b": 5e-324, "c": 123456789012345.6, "d": 1e-05, "e": True, "f": None, "g": 10**15}], list("abcdefg")))).read("xl/worksheets/sheet1.xml").decode()
    assert "_x005F_x0041_ &amp; &lt;b&gt;_x000D_" in sheet and ">5e-324</t>" in sheet and ">123456789012345.6</t>" in sheet and '<c t="n"><v>1e-05</v></c>' in sheet and '<c t="b"><v>1</v></c>' in sheet and "<c/>" in sheet and ">1000000000000000</t>" in sheet
    assert readers.xlsx([{"a": "😀" * 16383 + "a"}], ["a"])
    for bad in ("a\x0b", "\ud800", "\ufffe", "😀" * 16384, float("nan"), [1]):
        with pytest.raises(ValueError):
            readers.xlsx([{"a": bad}], ["a"])


def test_audit_of_missing_operands_and_tolerances(spark):
    headers = spark.createDataFrame([(1, "10.00", "1.00", "11.02", "2024-01-02", "2024-01-01"), (2, None, "1.00", "1.00", "2024-01-02", None), (3, "0.00", "0.00", "0.03", "2024-1-2", "2024-01-03")], "doc_id long, subtotal string, tax string, total string, issue_date string, due_date string")
    items = spark.createDataFrame([(1, 0, "2", "4.00", "8.00"), (1, 1, "1", None, "2.00"), (2, 0, "1", "1.00", None), (9, 0, "1", "1.00", "1.00")], "doc_id long, item_no long, quantity string, unit_price string, amount string")
    got = sorted((r.doc_id, r.check_no, r.rule.split(".")[1], r.status) for r in A.audit(headers, items).collect())
    assert got == [(1, 0, "line_extension", "passed"), (1, 1, "line_extension", "not_checked"), (1, 2, "items_subtotal", "passed"), (1, 3, "subtotal_tax_total", "passed"), (1, 4, "due_date_order", "failed"), (2, 0, "line_extension", "not_checked"), (2, 1, "items_subtotal", "not_checked"), (2, 2, "subtotal_tax_total", "not_checked"), (2, 3, "due_date_order", "not_checked"), (3, 0, "items_subtotal", "not_checked"), (3, 1, "subtotal_tax_total", "failed"), (3, 2, "due_date_order", "not_checked")]
    first = A.audit(headers, items, "receipt").where("doc_id = 1 and check_no = 0").first()
    assert first.fields == ["items[0].amount", "items[1].amount", "subtotal"] and A.issues(A.audit(headers, items)).count() == 2
    for bad in ("-0.01", "NaN", "Infinity"):
        with pytest.raises(ValueError):
            A.audit(headers, items, tolerance=bad)


def test_oversize_documents_and_unusable_claims_are_rejected(spark):
    words = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(65))).alias("page"), F.lit(0).alias("word_no"), F.lit("w").alias("text"), *(F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("top", 0), ("x1", 9), ("bottom", 9))), F.lit(False).alias("review_paint"))
    words = words.unionByName(words.where("page = 1").withColumn("doc_id", F.lit(2).cast("long")))
    claims = spark.createDataFrame([(1, 0, "a", '"w"', ["w"], None, None), (2, 0, "a", '"w"', ["w"], None, None), (2, 1, "b", "{", ["w"], None, None), (2, 2, "c", "[1]", ["w"], None, None), (2, 3, "d", "1e999", ["w"], None, None)], "doc_id long, field_no int, path string, value string, evidence array<string>, page int, declared_kind string")
    assert [(r.doc_id, r.path, r.status) for r in V.verify(words, claims).collect()] == [(2, "a", "verified")]
    assert sorted((r.doc_id, r.path or "", r.reason) for r in V.rejects(words, claims).collect()) == [(1, "", "too many pages"), (2, "b", "the value is no JSON"), (2, "c", "the value is no text, number or boolean"), (2, "d", "the value is not finite")]


def test_command_line(spark, tmp_path):
    for folder, name, data in (("e", "one", {"data": DATA, "model": "m"}), ("e", "two", {"total": {"value": 1, "evidence": ["x"]}}), ("d", "one", document("Total 12.50 Paid: yes")), ("d", "two", document("nothing here"))):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(json.dumps(data))
    (tmp_path / "e" / "bad.json").write_text('{"a":1,"a":2}')
    command.run(spark, ["verify", str(tmp_path / "e"), str(tmp_path / "d"), str(tmp_path / "out"), "--number-style", "decimal"])
    assert sorted((r.name, r.path, r.status) for r in spark.read.json(str(tmp_path / "out/fields")).collect()) == [("one", "paid", "verified"), ("one", "total", "verified"), ("two", "total", "unsupported")]
    assert [r.name for r in spark.read.json(str(tmp_path / "out/rejects")).collect()] == ["bad"]
    command.run(spark, ["replay", str(tmp_path / "e"), str(tmp_path / "again")])
    assert [r.path for r in spark.read.json(str(tmp_path / "again/fields")).where("source like '%one.json'").orderBy("field_no").collect()] == ["total", "paid"]
    with pytest.raises(ValueError):
        command.run(spark, ["replay", str(tmp_path / "e"), str(tmp_path / "e")])


def test_review_as_a_stream(spark, tmp_path):
    rows = [(1, "a", 1, "edit", "2"), (1, "a", 2, "approve", None), (1, "b", 3, "edit", '"no"'), (1, "b", 4, "reject", None), (1, "c", 5, "edit", "3"), (1, "c", 6, "extract", None), (1, "zz", 7, "approve", None), (1, "a", 8, "edit", "1e999")]
    schema = "doc_id long, path string, seq long, action string, value string"
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.json(str(tmp_path / "in"))
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    fields = spark.createDataFrame([(1, p, "1.5") for p in "abc"], "doc_id long, path string, value string")
    actions = review.accepted(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), fields)
    got = {}
    def keep(batch, _):
        got.update({r.path: (r.review_status, r.edited_value) for r in batch.collect()})
    stream = review.review_stream(actions).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert got == {"a": ("approved", "2"), "b": ("rejected", None), "c": ("pending", None)}
    batch = R.review_state(review.accepted(spark.createDataFrame(rows, schema), fields)).collect()
    assert {r.path: (r.review_status, r.edited_value) for r in batch} == got


def test_best_window_matches_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        short = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
        long = "".join(rng.choice("abc") for _ in range(rng.randint(len(short), 14)))
        n = len(short)
        spans = [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(len(long) - k, len(long)) for k in range(1, n)]
        def common(x, y):
            row = [0] * (len(y) + 1)
            for a in x:
                last = 0
                for j, b in enumerate(y):
                    last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j + 1], row[j])
            return row[-1]
        best = max(200.0 * common(short, long[a:b]) / (n + b - a) for a, b in spans)
        score, a, b = T.best_window(short, long)
        assert abs(score - best) < 1e-9 and abs(200.0 * common(short, long[a:b]) / (n + b - a) - best) < 1e-9


def test_budgets_and_occurrences(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.choice([None, 0, 3, 9])) for i in rng.sample(range(60_000), 400)] + [("a", None, 2), (None, 5, 1)]
    got = {(r.k, r.i, r.running) for r in R.within_budget(spark.createDataFrame(rows, "k string, i long, n long"), "k", "i", "n", 300, 500).collect()}
    want, total = set(), {}
    for k, i, n in sorted(rows, key=lambda r: (r[0] or "", -1 if r[1] is None else r[1])):
        total[k] = total.get(k, 0) + (n or 0)
        if total[k] <= 300:
            want.add((k, i, total[k]))
    assert got == want
    texts = ["ababab xabx", "aaaa aaaa", "", None, "é ab\ncd", "a"]
    quotes = ["ab", "aba", "aa", "a", "é", "zz", "", None, "abab"]
    found = R.occurrences_in_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string"))
    count = lambda t, q: sum(t.startswith(q, i) for i in range(len(t)))
    assert {tuple(r) for r in found.collect()} == {(i, j, count(t, q)) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and count(t, q)}


def test_reading_order_joins_words_of_a_line(spark):
    words = [("b", 50.0, 1.0, 60.0, 11.0), ("a", 0.0, 0.0, 10.0, 10.0), ("d", 0.0, 20.0, 10.0, 30.0), ("c", 90.0, 4.0, 99.0, 14.0), ("e", 0.0, 26.0, 10.0, 36.0)]
    df = spark.createDataFrame([(words,), ([],)], "w array<struct<text:string,x0:double,top:double,x1:double,bottom:double>>")
    assert [[x.text for x in r.w] for r in df.select(S.reading_order(F.col("w")).alias("w")).collect()] == [["a", "b", "c", "d", "e"], []]


def test_row_rules_name_what_the_schema_has():
    held = {"line_items": ["description", "quantity", "unit_price", "amount"]}
    assert V.check_rules(V.DEFAULT_RULES["Invoice"], held) == V.INVOICE_RULES
    for rules, schema in ((V.RECEIPT_RULES, held), (V.INVOICE_RULES * 2, held), (V.INVOICE_RULES, {"line_items": ["description"]})):
        with pytest.raises(ValueError):
            V.check_rules(rules, schema)
