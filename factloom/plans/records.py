"""Driver queries of audits, paint, corrections, exports, study sources and tables, and of quotes on
several pages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import audit as A
from factloom.operators import relational as R
from factloom.operators import study as S
from factloom.plans.catalog import _money, query, table

# ---------------------------------------------------------------- paint, audits


@query("""
WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 9 END AS mode, CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_suppkey % 7 = 1 END AS clear, l_suppkey % 11 = 2 AS clipped,
  CASE l_partkey % 7 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'no_contribution' WHEN 2 THEN 'ambiguous_overlap' WHEN 3 THEN NULL ELSE 'contributes' END AS state FROM lineitem),
f AS (SELECT *, coalesce(mode IN (3, 7), FALSE) AS a, coalesce(clear, FALSE) AS b, coalesce(state = 'no_contribution', FALSE) AS d, coalesce(state = 'ambiguous_overlap', FALSE) AS e,
  coalesce(mode IN (3, 7), FALSE) OR coalesce(clear, FALSE) OR clipped OR coalesce(state <> 'contributes', FALSE) OR (mode IS NOT NULL AND state IS NULL) AS asks FROM w)
SELECT l_orderkey, concat_ws(',', CASE WHEN bool_or(a) THEN 'unpainted' END, CASE WHEN bool_or(b) THEN 'transparent' END, CASE WHEN bool_or(clipped) THEN 'clipped' END, CASE WHEN bool_or(d) THEN 'no_contribution' END,
  CASE WHEN bool_or(e) THEN 'ambiguous_overlap' END, CASE WHEN bool_or(asks AND NOT (a OR b OR clipped OR d OR e)) THEN 'unchecked' END) AS kinds FROM f GROUP BY 1""")
def paint_reasons(spark, sf_dir):
    """The kinds of reasons that an order's lines, taken as words of one quote, give for review."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    state = F.when(part % 7 == 0, "unavailable").when(part % 7 == 1, "no_contribution").when(part % 7 == 2, "ambiguous_overlap").when(part % 7 > 3, "contributes")
    kinds = C.paint_kinds(F.when(part % 3 != 0, part % 9), F.when(supp % 6 != 0, supp % 7 == 1), supp % 11 == 2, state)
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_distinct(F.flatten(F.collect_list(kinds))).alias("k"))
    ordered = F.filter(F.array(*map(F.lit, C.PAINT_KINDS)), lambda k: F.array_contains("k", k))
    return held.select("l_orderkey", F.array_join(ordered, ",").alias("kinds"))


_AUDIT_SQL = """
WITH i AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS no, CAST(l_quantity AS DECIMAL(12,2)) AS q,
  CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS e, l_suppkey FROM lineitem),
j AS (SELECT *, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(CAST(e * 100 AS BIGINT) // CAST(q AS BIGINT) AS DECIMAL(12,2)) * 0.01 END AS u FROM i),
s AS (SELECT d, count(*) AS n, count(amount) AS known, sum(amount) AS total FROM j GROUP BY 1),
o AS (SELECT o_orderkey AS d, coalesce(n, 0) AS n, CASE WHEN n > 0 AND n = known THEN total END AS items, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE coalesce(s2, 0) + CASE WHEN o_orderkey % 3 = 0 THEN 0.05 ELSE 0.02 END END AS subtotal,
  CAST(o_totalprice AS DECIMAL(18,2)) AS total, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) - coalesce(s2, 0) END AS tax, CAST(o_orderdate AS DATE) AS issue, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 - 2 AS INTEGER) AS due, o_orderkey % 6 = 0 AS odd
  FROM orders LEFT JOIN (SELECT *, total AS s2 FROM (SELECT d, n, known, total FROM s)) x ON o_orderkey = d),
c AS (SELECT j.d, j.no AS check_no, 'invoice.line_extension' AS rule, amount AS observed, q * u AS computed FROM j JOIN o USING (d)
  UNION ALL SELECT d, n, 'invoice.items_subtotal', subtotal, items FROM o UNION ALL SELECT d, n + 1, 'invoice.subtotal_tax_total', total, subtotal + tax FROM o)
SELECT d AS doc_id, CAST(check_no AS BIGINT) AS check_no, rule, CASE WHEN observed IS NULL OR computed IS NULL THEN 'not_checked' WHEN abs(observed - computed) <= 0.02 THEN 'passed' ELSE 'failed' END AS status, CAST(CASE WHEN computed IS NOT NULL THEN observed - computed END AS DOUBLE) AS difference FROM c
UNION ALL SELECT d, n + 2, 'invoice.due_date_order', CASE WHEN odd THEN 'not_checked' WHEN due < issue THEN 'failed' ELSE 'passed' END, NULL FROM o
"""


def _audited(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    q, e = F.col("l_quantity").cast("decimal(12,2)"), _money("l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.row_number().over(by) - 1).cast("long").alias("item_no"), q.alias("quantity"), F.when(F.col("l_suppkey") % 5 != 0, F.expr("cast(cast(l_extendedprice as decimal(18,2)) * 100 as bigint) div cast(l_quantity as bigint)").cast("decimal(12,2)") * F.lit("0.01").cast("decimal(3,2)")).alias("unit_price"), F.when(F.col("l_partkey") % 17 != 0, e).alias("amount"))
    k = F.col("o_orderkey")
    known = items.groupBy("doc_id").agg(F.sum("amount").alias("_s"))
    orders = table(spark, sf_dir, "orders").join(known, k == F.col("doc_id"), "left").withColumn("_s", F.coalesce("_s", F.lit(0).cast("decimal(18,2)")))
    more = F.when(k % 3 == 0, F.lit("0.05")).otherwise("0.02").cast("decimal(10,2)")
    day = F.to_date("o_orderdate")
    due = F.date_format(F.date_add(day, (k % 5 - 2).cast("int")), "yyyy-MM-dd")
    headers = orders.select(k.alias("doc_id"), F.when(k % 4 != 0, F.col("_s") + more).alias("subtotal"), F.when(k % 7 != 0, _money("o_totalprice") - F.col("_s")).alias("tax"), _money("o_totalprice").alias("total"), F.date_format(day, "yyyy-MM-dd").alias("issue_date"), F.when(k % 6 != 0, due).alias("due_date"))
    return headers, items


@query(_AUDIT_SQL)
def invoice_audit(spark, sf_dir):
    """Every order audited as an invoice, in the order of the rules."""
    checks = A.audit(*_audited(spark, sf_dir), "invoice")
    return checks.select("doc_id", "check_no", "rule", "status", F.when(F.col("status") != "not_checked", F.col("difference")).cast("double").alias("difference"))


@query("WITH a AS (" + _AUDIT_SQL + ") SELECT doc_id, CAST(min(check_no) - (SELECT count(*) FILTER (rule = 'invoice.line_extension') FROM a b WHERE b.doc_id = a.doc_id) AS BIGINT) AS first_no, max(CASE rule WHEN 'invoice.items_subtotal' THEN status END) AS items_subtotal, max(CASE rule WHEN 'invoice.subtotal_tax_total' THEN status END) AS subtotal_tax_total FROM a WHERE rule IN ('invoice.items_subtotal', 'invoice.subtotal_tax_total') GROUP BY 1")
def receipt_audit(spark, sf_dir):
    checks = A.audit(*_audited(spark, sf_dir), "receipt")
    of = lambda rule: F.max(F.when(F.col("rule") == f"receipt.{rule}", F.col("status"))).alias(rule)
    return checks.groupBy("doc_id").agg(F.min("check_no").alias("first_no"), of("items_subtotal"), of("subtotal_tax_total"))


# ---------------------------------------------------------------- corrections, limits, exports

_CORRECTIONS = (("1.5", "2", True), ("1", "2.25", True), ("1", "true", False), ("1", '"2"', False), ("1", "1e999", False), ("1", "null", False), ("true", "false", True), ("false", "0", False), ('"a"', '"b"', True), ('"a"', "1", False), ('"a"', "null", False), ('"a"', '""', True), ("1", "bad", False), ("1", '{"v":1}', False), ("-3", "-0.5e-7", True))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b, _ in _CORRECTIONS) + """) v(original, correction)),
k AS (SELECT *, CASE WHEN json_valid(original) THEN json_type(original) END AS a, CASE WHEN json_valid(correction) THEN json_type(correction) END AS b FROM p),
n AS (SELECT *, CASE WHEN a IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN 'N' WHEN a = 'BOOLEAN' THEN 'B' WHEN a = 'VARCHAR' THEN 'T' END AS x, CASE WHEN b IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND correction <> '1e999' THEN 'N' WHEN b = 'BOOLEAN' THEN 'B' WHEN b = 'VARCHAR' THEN 'T' END AS y FROM k)
SELECT r_regionkey, original, correction, coalesce(x = y, FALSE) AS valid FROM n, region"""
)
def valid_corrections(spark, sf_dir):
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("original"), F.lit(b).alias("correction")) for a, b, _ in _CORRECTIONS)))
    rows = table(spark, sf_dir, "region").select("r_regionkey", pairs.alias("p")).select("r_regionkey", "p.*")
    return rows.withColumn("valid", C.valid_correction(F.col("original"), F.col("correction")))


@query("""
WITH b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'upload' WHEN 2 THEN 'other' ELSE 'archive' END AS route, octet_length(encode(repeat(text, CASE WHEN doc_id % 8 = 0 THEN 400 ELSE 1 END))) AS n FROM documents)
SELECT route, CASE WHEN route = 'other' THEN 'unknown_route' WHEN n > CASE route WHEN 'json' THEN 1048576 WHEN 'upload' THEN 20971520 ELSE 67108864 END THEN 'too_large' ELSE 'ok' END AS verdict, count(*) AS n FROM b GROUP BY 1, 2""")
def body_limits(spark, sf_dir):
    k = F.col("doc_id")
    route = F.when(k % 4 == 0, "json").when(k % 4 == 1, "upload").when(k % 4 == 2, "other").otherwise("archive")
    body = F.when(k % 8 == 0, F.repeat("text", F.lit(400))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select(route.alias("route"), C.body_verdict(route, body).alias("verdict")).groupBy("route", "verdict").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN 'a & <b> "c"' || chr(13) || chr(10) || text WHEN 2 THEN '_x0041_ _x00g1_ __x1F600_' || text WHEN 3 THEN chr(7) || text WHEN 4 THEN repeat('😀', 16383) || CASE WHEN doc_id % 12 = 4 THEN 'ab' ELSE 'a' END ELSE repeat('y', 32767) END AS said FROM documents),
u AS (SELECT *, length(said) + length(regexp_replace(said, '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units, regexp_matches(said, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]') AS bad FROM t)
SELECT doc_id, CASE WHEN bad THEN 'characters' WHEN units > 32767 THEN 'length' END AS problem,
  CASE WHEN NOT bad AND units <= 32767 THEN sha256(replace(replace(replace(replace(regexp_replace(said, '_(x[0-9a-fA-F]{4}_)', '_x005F_\1', 'g'), '&', '&amp;'), '>', '&gt;'), '<', '&lt;'), chr(13), '_x000D_')) END AS content FROM u""")
def xlsx_cells(spark, sf_dir):
    """Texts as they stand in a sheet's cells, or why they can't."""
    k = F.col("doc_id")
    odd = [F.col("text"), F.concat(F.lit('a & <b> "c"\r\n'), "text"), F.concat(F.lit("_x0041_ _x00g1_ __x1F600_"), "text"), F.concat(F.lit("\x07"), "text"), F.concat(F.repeat(F.lit("😀"), F.lit(16383)), F.when(k % 12 == 4, "ab").otherwise("a")), F.repeat(F.lit("y"), F.lit(32767))]
    said = F.when(k % 6 == 0, odd[0])
    for i, x in enumerate(odd[1:], 1):
        said = said.when(k % 6 == i, x)
    cells = table(spark, sf_dir, "documents").select("doc_id", C.cell_text(said).alias("c"))
    return cells.select("doc_id", "c.problem", F.sha2("c.content", 256).alias("content"))


@query("""
WITH f AS (SELECT o_orderkey AS doc_id, p AS path, CASE p WHEN 'total' THEN CAST(o_totalprice AS VARCHAR) ELSE '"' || o_orderstatus || '"' END AS value FROM orders, (SELECT unnest(['total', 'status']) AS p)),
d AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 AND path = 'status' THEN 'stranger' ELSE path END AS path, CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'edited' WHEN 3 THEN 'rejected' ELSE 'lost' END AS st, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN '"new"' ELSE '7' END AS ed, doc_id % 17 = 0 AS twice FROM f WHERE doc_id % 11 <> 0 OR path = 'total'),
g AS (SELECT doc_id, path, any_value(st) AS st, any_value(ed) AS ed, sum(CASE WHEN twice THEN 2 ELSE 1 END) AS n FROM d GROUP BY 1, 2),
b AS (SELECT coalesce(f.doc_id, g.doc_id) AS doc_id, f.path AS fp, g.path AS gp, value, st, ed, n FROM f FULL OUTER JOIN g ON f.doc_id = g.doc_id AND f.path = g.path),
p AS (SELECT doc_id, unnest([CASE WHEN gp IS NULL THEN 'missing' END, CASE WHEN fp IS NULL THEN 'unknown' END, CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN fp IS NOT NULL AND gp IS NOT NULL AND st = 'lost' THEN 'state' END,
  CASE WHEN fp IS NOT NULL AND gp IS NOT NULL AND ((st = 'pending' AND ed IS NOT NULL) OR (st = 'edited' AND ed IS NULL)) THEN 'correction' END, CASE WHEN fp IS NOT NULL AND gp IS NOT NULL AND ed IS NOT NULL AND (value[1] = '"') <> (ed[1] = '"') THEN 'type' END]) AS problem FROM b)
SELECT doc_id, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1, 2""")
def review_invariants(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    item = lambda path, value: F.struct(F.lit(path).alias("path"), value.alias("value"))
    f = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(item("total", F.col("o_totalprice").cast("string")), item("status", F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))))).alias("f")).select("doc_id", "f.*")
    k = F.col("doc_id")
    state = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "approved").when(k % 5 == 2, "edited").when(k % 5 == 3, "rejected").otherwise("lost")
    d = f.where("doc_id % 11 <> 0 or path = 'total'").select("doc_id", F.when((k % 13 == 0) & (F.col("path") == "status"), "stranger").otherwise(F.col("path")).alias("path"), state.alias("review_status"), F.when(k % 3 == 0, F.lit(None)).when(k % 4 == 0, '"new"').otherwise("7").alias("edited_value"))
    return R.review_problems(f, d.unionByName(d.where("doc_id % 17 = 0")))


@query("""
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS i FROM lineitem WHERE l_partkey % 50 <> 0), a AS (SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_suppkey % 40 = 0 THEN NULL ELSE l_partkey END AS i FROM lineitem WHERE l_partkey % 60 <> 0 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey % 70 = 0),
x AS (SELECT k, n, count(*) AS c, list_sort(list(coalesce(i, -1))) AS v FROM b GROUP BY 1, 2), y AS (SELECT k, n, count(*) AS c, list_sort(list(coalesce(i, -1))) AS v FROM a GROUP BY 1, 2)
SELECT count(*) FILTER (y.c IS NULL) AS n_only_before, count(*) FILTER (x.c IS NULL) AS n_only_after, count(*) FILTER (coalesce(x.c, 0) > 1 OR coalesce(y.c, 0) > 1) AS n_repeated, count(*) FILTER (x.v[1] <> y.v[1] OR x.v[-1] <> y.v[-1]) AS n_unlike FROM x FULL OUTER JOIN y ON x.k = y.k AND x.n = y.n""")
def paired_run_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("i"), "l_suppkey")
    after = rows.where("i % 60 <> 0").withColumn("i", F.when(F.col("l_suppkey") % 40 != 0, F.col("i"))).unionByName(rows.where("i % 70 = 0"))
    return R.run_problems(rows.where("i % 50 <> 0"), after, ["k", "n"], ["i"])


# ---------------------------------------------------------------- study sources and tables


@query(r"""
WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\n'), 1) AS line_no FROM documents WHERE n_chars < 3000),
w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM l),
f AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) - 1 AS word_no, unnest(ws) AS word, list_sum(list_transform(ws, lambda x: length(x))) + len(ws) - 1 AS total FROM w WHERE len(ws) > 0),
o AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(word_no AS BIGINT) AS word_no, word AS text, CAST(round(10 + 500.0::DOUBLE * before / total + 0.0000137, 3) AS DOUBLE) AS x0, CAST(round(10 + 500.0::DOUBLE * (before + length(word)) / total + 0.0000137, 3) AS DOUBLE) AS x1 FROM o""")
def recognised_line_words(spark, sf_dir):
    """The lines of short documents as recognised lines of one box each, shared out to words."""
    lines = table(spark, sf_dir, "documents").where("n_chars < 3000").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    boxes = lines.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "text", F.lit(10.0).alias("x0"), (F.col("i") * 12.0).alias("top"), F.lit(510.0).alias("x1"), (F.col("i") * 12.0 + 10).alias("bottom"))
    return S.line_words(boxes).select("doc_id", "line_no", "word_no", "text", F.round(F.col("x0") + 0.0000137, 3).alias("x0"), F.round(F.col("x1") + 0.0000137, 3).alias("x1"))


_RECEIPT_SQL = """
WITH l AS (SELECT l_orderkey AS d, l_linenumber AS n, l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
k AS (SELECT * FROM l WHERE rn = 1),
w AS (SELECT d, n, 'part' || l_partkey AS text, 0 AS x, 'menu.nm' AS kind FROM k UNION ALL SELECT d, n, 'no' || q, 60, 'menu.nm' FROM k UNION ALL SELECT d, n, price, 200, 'menu.price' FROM k UNION ALL SELECT d, n, 'USD', 190, NULL FROM k)
"""


def _receipts(spark, sf_dir) -> DataFrame:
    """Orders as annotated receipts: two lines an item, one of its name and one of its price with a
    key word, whose words' middles scatter within a few points."""
    from pyspark.sql.window import Window

    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")
    one = table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(by)).where("rn = 1")

    def word(text, x, shift, key=0):
        y = F.col("l_linenumber") * F.lit(20.0) + F.lit(float(shift))
        corner = [F.lit(float(x)).alias("x1"), y.alias("y1"), F.lit(float(x + 9)).alias("x2"), y.alias("y2"), F.lit(float(x + 9)).alias("x3"), (y + 10).alias("y3"), F.lit(float(x)).alias("x4"), (y + 10).alias("y4")]
        return F.struct(text.alias("text"), F.lit(key).alias("is_key"), F.struct(*corner).alias("quad"))

    name = F.struct(F.lit("menu.nm").alias("category"), F.array(word(F.concat(F.lit("no"), F.col("l_quantity").cast("long").cast("string")), 60, 2), word(F.concat(F.lit("part"), F.col("l_partkey").cast("string")), 0, 0)).alias("words"))
    price = F.struct(F.lit("menu.price").alias("category"), F.array(word(_money("l_extendedprice").cast("string"), 200, 3), word(F.lit("USD"), 190, 1, 1), word(F.lit(" "), 100, 0)).alias("words"))
    lines = one.groupBy("l_orderkey").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(name, price).alias("x")))), lambda x: x["x"])).alias("valid_line"))
    truth = F.struct(F.struct(F.lit("train").alias("split"), F.col("l_orderkey").alias("image_id")).alias("meta"), "valid_line")
    return lines.select(F.to_json(truth).alias("ground_truth"))


@query(_RECEIPT_SQL + "SELECT 'cord-train-' || d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY n, x) - 1 AS word_no, text, kind FROM w")
def annotated_receipt_words(spark, sf_dir):
    return S.annotated_words(_receipts(spark, sf_dir)).select("doc_id", "word_no", "text", "kind")


@query(_RECEIPT_SQL + "SELECT 'cord-train-' || d AS doc_id, kind, array_to_string(list(text ORDER BY x), ' ') AS text, count(*) AS n_words FROM w WHERE kind IS NOT NULL GROUP BY d, n, kind")
def receipt_gold_fields(spark, sf_dir):
    return S.gold_fields(S.annotated_words(_receipts(spark, sf_dir))).select("doc_id", "kind", "text", "n_words")


_RUNS_SQL = """
WITH r AS (SELECT CASE WHEN l_partkey % 2 = 0 THEN 'cord' ELSE 'sroie' END AS dataset, CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS split, l_orderkey % 500 AS doc, CASE l_linenumber % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'date' ELSE 'text' END AS ftype,
  CASE l_suppkey % 4 WHEN 0 THEN 'ocr_garble' WHEN 1 THEN 'absent' ELSE 'present_written' END AS measure, CASE l_partkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'page_context' ELSE 'true_quote' END AS quote_style, CASE l_partkey % 5 WHEN 0 THEN 'scaled_wrong' WHEN 1 THEN 'day_month_swapped' ELSE 'none' END AS variant,
  CASE WHEN l_quantity < 20 THEN 'verified' ELSE 'needs_review' END AS status, CASE l_suppkey % 3 WHEN 0 THEN 'the quote occurs 2 times' WHEN 1 THEN '60.000 reads as 60 or 60000' ELSE 'odd' END AS reason, l_linenumber AS dup_on_page, l_quantity > 40 AS present_elsewhere, l_partkey % 4 < 2 AS locale_ambiguous,
  'Total ' || CASE WHEN l_partkey % 8 < 3 THEN '60,000' ELSE '60.000' END AS quote, l_discount > 0.05 AS place_ok FROM lineitem)
"""


def _evaluation(spark, sf_dir) -> DataFrame:
    part, supp, line, q = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(part % 2 == 0, "cord").otherwise("sroie").alias("dataset"), F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B").alias("split"), (F.col("l_orderkey") % 500).alias("doc"), F.when(line % 3 == 0, "amount").when(line % 3 == 1, "date").otherwise("text").alias("ftype"),
        F.when(supp % 4 == 0, "ocr_garble").when(supp % 4 == 1, "absent").otherwise("present_written").alias("measure"), F.when(part % 3 == 0, "page").when(part % 3 == 1, "page_context").otherwise("true_quote").alias("quote_style"), F.when(part % 5 == 0, "scaled_wrong").when(part % 5 == 1, "day_month_swapped").otherwise("none").alias("variant"),
        F.when(q < 20, "verified").otherwise("needs_review").alias("status"), F.when(supp % 3 == 0, "the quote occurs 2 times").when(supp % 3 == 1, "60.000 reads as 60 or 60000").otherwise("odd").alias("reason"), line.alias("dup_on_page"), (q > 40).alias("present_elsewhere"), (part % 4 < 2).alias("locale_ambiguous"),
        F.concat(F.lit("Total "), F.when(part % 8 < 3, "60,000").otherwise("60.000")).alias("quote"), (F.col("l_discount") > 0.05).alias("place_ok"),
    )


@query(_RUNS_SQL + """, t AS (SELECT * FROM r WHERE measure <> 'ocr_garble')
SELECT 'documents' AS section, dataset || '/' || split AS key, count(DISTINCT doc) AS n FROM t GROUP BY 2
UNION ALL SELECT 'annotated_fields', dataset || '/' || split || '/' || ftype, count(*) FROM t WHERE measure = 'present_written' AND quote_style = 'page' GROUP BY 2
UNION ALL SELECT 'written_more_than_once', unnest(['fields', status]), count(*) FROM t WHERE measure = 'present_written' AND quote_style = 'page' AND dup_on_page > 1 GROUP BY 2
UNION ALL SELECT 'not_verified', ftype || ': ' || CASE WHEN reason LIKE '%occurs%' THEN 'ambiguous' WHEN reason LIKE '%reads as%' THEN 'undecided number' ELSE 'other' END, count(*) FROM t WHERE measure = 'present_written' AND quote_style = 'page_context' AND status <> 'verified' GROUP BY 2
UNION ALL SELECT 'absent', 'cases', count(*) FROM t WHERE measure = 'absent' AND quote_style = 'true_quote' HAVING count(*) > 0 UNION ALL SELECT 'absent', 'value_also_on_page', count(*) FROM t WHERE measure = 'absent' AND quote_style = 'true_quote' AND present_elsewhere HAVING count(*) > 0""")
def evaluation_summary(spark, sf_dir):
    return S.data_summary(_evaluation(spark, sf_dir))


@query(_RUNS_SQL + """
SELECT dataset || ' ' || CASE WHEN ftype = 'date' THEN 'date' WHEN quote LIKE '%,%' THEN 'amount d,ddd' ELSE 'amount d.ddd' END || CASE WHEN measure = 'present_written' THEN ', true value' ELSE ', other reading' END AS key, count(*) AS cases, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'verified' AND place_ok) AS verified_at_the_right_place
FROM r WHERE quote_style IN ('page_context', 'true_quote') AND ((ftype = 'amount' AND locale_ambiguous AND (measure = 'present_written' OR (measure = 'absent' AND variant = 'scaled_wrong'))) OR (ftype = 'date' AND (measure = 'present_written' OR (measure = 'absent' AND variant = 'day_month_swapped')))) GROUP BY 1""")
def unsettled_fields(spark, sf_dir):
    return S.unsettled_table(_evaluation(spark, sf_dir))


@query(r"""
WITH a AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS v, p_name FROM part)
SELECT p_partkey, 'plain' AS variant, regexp_replace(regexp_replace(CAST(v AS VARCHAR), '0+$', ''), '\.$', '') AS said FROM a UNION ALL SELECT p_partkey, 'two_decimals', CAST(v AS VARCHAR) FROM a UNION ALL SELECT p_partkey, 'grouped', format('{:,.2f}', CAST(v AS DOUBLE)) FROM a
UNION ALL SELECT p_partkey, 'lower', lower(p_name) FROM a UNION ALL SELECT p_partkey, 'no_punct', regexp_replace(p_name, '[^a-zA-Z0-9_ ]', '', 'g') FROM a UNION ALL SELECT p_partkey, 'trim_trailing', regexp_replace(trim(p_name, ' ,.'), '\s+', ' ', 'g') FROM a
UNION ALL SELECT p_partkey, 'drop_first_word', array_to_string(list_slice(string_split(p_name, ' '), 2, 99), ' ') FROM a WHERE len(string_split(p_name, ' ')) >= 3 UNION ALL SELECT p_partkey, 'drop_last_word', array_to_string(list_slice(string_split(p_name, ' '), 1, len(string_split(p_name, ' ')) - 1), ' ') FROM a WHERE len(string_split(p_name, ' ')) >= 3""")
def value_variants(spark, sf_dir):
    """How a model may write each part's price and name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.concat(S.amount_variants(_money("p_retailprice")), S.text_variants(F.col("p_name")))).alias("v"))
    return rows.select("p_partkey", "v.*")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS s FROM lineitem),
p AS (SELECT *, list_filter(range(1, length(s) + 1), lambda i: s[i] BETWEEN '0' AND '9') AS pos, list_filter(range(1, length(s)), lambda i: (s[i] BETWEEN '0' AND '9') AND (s[i + 1] BETWEEN '0' AND '9') AND s[i] <> s[i + 1] AND NOT (i = 1 AND s[2] = '0')) AS sw FROM t),
k AS (SELECT *, pos[l_partkey % len(pos) + 1] AS i, CASE WHEN len(sw) > 0 THEN sw[l_partkey % len(sw) + 1] END AS j FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, s, s[1:i - 1] || CASE WHEN s[i] = '9' AND i = pos[1] AND len(pos) > 1 THEN '1' ELSE CAST((CAST(s[i] AS INTEGER) + 1) % 10 AS VARCHAR) END || s[i + 1:] AS changed, CASE WHEN j IS NOT NULL THEN s[1:j - 1] || s[j + 1] || s[j] || s[j + 2:] END AS swapped FROM k""")
def value_mutants(spark, sf_dir):
    """Prices with one digit changed or two swapped, as wrong claims."""
    said = _money("l_extendedprice").cast("string")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", said.alias("s"))
    return rows.select("*", S.changed_digit(F.col("s"), F.col("l_partkey")).alias("changed"), S.swapped_digits(F.col("s"), F.col("l_partkey")).alias("swapped"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS k FROM orders), t AS (SELECT *, CASE k WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%-d.%-m.%Y') WHEN 2 THEN strftime(day, '%d-%m-%y') ELSE strftime(day, '%d/%m-%Y') END AS said FROM d),
p AS (SELECT *, CASE WHEN k = 3 THEN NULL WHEN k = 2 THEN make_date(CAST(2000 + year(day) % 100 AS BIGINT), month(day), day(day)) ELSE day END AS read FROM t)
SELECT o_orderkey, said, CAST(read AS VARCHAR) AS day, CASE k WHEN 0 THEN strftime(read + 1, '%d/%m/%Y') WHEN 1 THEN CASE WHEN length(string_split(said, '.')[1]) = 2 THEN strftime(read + 1, '%d') ELSE strftime(read + 1, '%-d') END || '.' || CASE WHEN length(string_split(said, '.')[2]) = 2 THEN strftime(read + 1, '%m') ELSE strftime(read + 1, '%-m') END || '.' || strftime(read + 1, '%Y') WHEN 2 THEN strftime(read + 1, '%d-%m-%y') END AS next_day FROM p""")
def day_first_dates(spark, sf_dir):
    """Dates written day first, and the next day in the same spelling."""
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.date_format(day, "dd/MM/yyyy")).when(k == 1, F.date_format(day, "d.M.yyyy")).when(k == 2, F.date_format(day, "dd-MM-yy")).otherwise(F.date_format(day, "dd/MM-yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"))
    read = C.day_first(F.col("said"))
    return rows.select("o_orderkey", "said", read.cast("string").alias("day"), C.written_like(F.col("said"), F.date_add(read, 1)).alias("next_day"))


# ---------------------------------------------------------------- quotes on several pages

_PAGES_SQL = r"""
WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents WHERE n_chars < 2500),
d AS (SELECT doc_id, ws FROM c WHERE len(ws) >= 18),
p AS (SELECT doc_id, ws, unnest([1, 2, 3]) AS page FROM d),
g AS (SELECT doc_id, page, ws[(page - 1) * (len(ws) // 3) + 1 : CASE WHEN page = 3 THEN len(ws) ELSE page * (len(ws) // 3) END] AS pw FROM p),
q AS (SELECT doc_id, ws, unnest([0, 1, 2, 3]) AS quote_no FROM d),
a AS (SELECT doc_id, quote_no, CASE quote_no WHEN 0 THEN ws[2:3] WHEN 1 THEN [ws[len(ws)]] WHEN 2 THEN [upper(ws[5]), upper(ws[6])] ELSE [ws[len(ws) // 3 + 2]] END AS qw, CASE WHEN doc_id % 2 = 0 THEN 2 END AS hint FROM q),
o AS (SELECT a.doc_id, quote_no, page, hint, qw, unnest(range(1, len(pw) - len(qw) + 2)) AS i, pw FROM a JOIN g USING (doc_id) WHERE len(pw) >= len(qw)),
m AS (SELECT doc_id, quote_no, page, hint, list_slice(pw, i, i + len(qw) - 1) = qw AS exact, list_transform(list_slice(pw, i, i + len(qw) - 1), lambda x: lower(x)) = list_transform(qw, lambda x: lower(x)) AS fold FROM o),
s AS (SELECT doc_id, quote_no, any_value(hint) AS hint, count(*) FILTER (exact) AS ne, count(*) FILTER (fold) AS nf, min(CASE WHEN exact THEN CASE WHEN hint IS NOT NULL AND page <> hint THEN 10 ELSE 0 END + page END) AS pe, min(CASE WHEN fold THEN CASE WHEN hint IS NOT NULL AND page <> hint THEN 10 ELSE 0 END + page END) AS pf FROM m GROUP BY 1, 2)
"""


def _paged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Short documents' words, letters only, as three pages each, and four quotes: two words of the
    first page, the last word, two words in capitals and a word of the second page."""
    docs = table(spark, sf_dir, "documents").where("n_chars < 2500").select("doc_id", F.filter(F.split(F.regexp_replace("text", "[^a-zA-Z]+", " "), " "), lambda x: x != "").alias("ws")).where(F.size("ws") >= 18)
    third = F.floor(F.size("ws") / 3).cast("int")
    flat = docs.select("doc_id", third.alias("third"), F.posexplode("ws").alias("i", "text"))
    page = F.least(F.floor(F.col("i") / F.col("third")) + 1, F.lit(3)).cast("int")
    no = F.col("i") - (page - 1) * F.col("third")
    words = flat.select("doc_id", page.alias("page"), no.alias("word_no"), "text", (no * 10.0).alias("x0"), F.lit(0.0).alias("top"), (no * 10.0 + 9).alias("x1"), F.lit(10.0).alias("bottom"), F.lit(False).alias("review_paint"))
    at = lambda k: F.get("ws", F.lit(k) if isinstance(k, int) else k)
    said = F.array(F.concat_ws(" ", at(1), at(2)), at(F.size("ws") - 1), F.upper(F.concat_ws(" ", at(4), at(5))), at(third + 1))
    quotes = docs.select("doc_id", F.posexplode(said).alias("quote_no", "quote"), F.when(F.col("doc_id") % 2 == 0, 2).alias("page"))
    return words, quotes


@query(_PAGES_SQL + "SELECT doc_id, CAST(quote_no AS INTEGER) AS quote_no, CASE WHEN ne > 0 THEN 'exact' ELSE 'folded' END AS rung, CAST(CASE WHEN ne > 0 THEN ne ELSE nf END AS INTEGER) AS n_places, CAST(CASE WHEN ne > 0 THEN pe ELSE pf END % 10 AS INTEGER) AS page FROM s")
def quotes_on_pages(spark, sf_dir):
    """Where quotes stand in documents of several pages: exact places on all pages before folded
    ones on any, the hinted page first."""
    from factloom.operators.verify import locate

    return locate(*_paged(spark, sf_dir)).select("doc_id", "quote_no", "rung", "n_places", "page")


@query(_PAGES_SQL + """, v AS (SELECT s.*, CASE WHEN ne > 0 THEN ne ELSE nf END AS n FROM s)
SELECT doc_id, 'word' || quote_no AS path, CASE WHEN n > 1 THEN 'needs_review' WHEN quote_no = 3 AND doc_id % 3 = 0 THEN 'needs_review' ELSE 'verified' END AS status, CAST(CASE WHEN n > 1 OR (quote_no = 3 AND doc_id % 3 = 0) THEN 1 ELSE 0 END AS INTEGER) AS n_reasons, CAST(CASE WHEN n = 1 THEN CASE WHEN ne > 0 THEN pe ELSE pf END % 10 END AS INTEGER) AS page FROM v""")
def verify_pages(spark, sf_dir):
    """Claims about documents of several pages: one whose quote stands in several places or whose
    value the quote doesn't say needs review, and only a single place is kept."""
    from factloom.operators.verify import verify

    words, quotes = _paged(spark, sf_dir)
    value = F.when((F.col("quote_no") == 3) & (F.col("doc_id") % 3 == 0), F.concat(F.col("quote"), F.lit("zq"))).otherwise(F.col("quote"))
    claims = quotes.select("doc_id", F.col("quote_no").alias("field_no"), F.concat(F.lit("word"), F.col("quote_no").cast("string")).alias("path"), F.concat(F.lit('"'), value, F.lit('"')).alias("value"), F.array("quote").alias("evidence"), F.col("page"), F.lit("text").alias("declared_kind"))
    return verify(words, claims).select("doc_id", "path", "status", F.size("reasons").alias("n_reasons"), "page")


@query("""
WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS field_no, CASE l_partkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN 'null' WHEN 2 THEN '{"a":1}' WHEN 3 THEN '1e999' WHEN 4 THEN '"ok"' WHEN 5 THEN 'true' ELSE '2.5' END AS value FROM lineitem),
w AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_partkey % 97) AS pages FROM lineitem WHERE l_orderkey % 40 = 0 GROUP BY 1)
SELECT CASE value WHEN 'x' THEN 'the value is no JSON' WHEN '1e999' THEN 'the value is not finite' ELSE 'the value is no text, number or boolean' END AS reason, count(*) AS n FROM b WHERE value IN ('x', 'null', '{"a":1}', '1e999') GROUP BY 1
UNION ALL SELECT 'too many pages', count(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 40 = 0) HAVING count(*) > 0""")
def rejected_claims(spark, sf_dir):
    """What verification leaves out: claims without a scalar value, documents of 65 pages."""
    from factloom.operators.verify import rejects

    k = F.col("l_partkey") % 7
    value = F.when(k == 0, "x").when(k == 1, "null").when(k == 2, '{"a":1}').when(k == 3, "1e999").when(k == 4, '"ok"').when(k == 5, "true").otherwise("2.5")
    lines = table(spark, sf_dir, "lineitem")
    claims = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_no"), F.lit("p").alias("path"), value.alias("value"))
    words = lines.where("l_orderkey % 20 = 0").select(F.col("l_orderkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.when(F.col("l_orderkey") % 40 == 0, 65).otherwise(64))).alias("page"), F.lit("w").alias("text"))
    return rejects(words, claims).groupBy("reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- strings, sources, geometry

_SAID = (("{}", 1), ("{} ltd", 1), ("the {}.", 1), ("{}x", 0), ("z{}", 0))


@query(r"""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey // 5 % 4 AS j, p_name, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT *, CASE j WHEN 0 THEN p_name WHEN 1 THEN upper(w[1]) || '-' || w[2] WHEN 2 THEN w[1] || ' ' || w[3] ELSE w[1][1:2] END AS value, CASE k WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ltd' WHEN 2 THEN 'the ' || p_name || '.' WHEN 3 THEN p_name || 'x' ELSE 'z' || p_name END AS evidence FROM p),
a AS (SELECT *, list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda x: x <> '') AS vw, list_filter(regexp_split_to_array(lower(evidence), '[^a-z0-9]+'), lambda x: x <> '') AS ew FROM t),
r AS (SELECT *, list_has(flatten(list_transform(range(1, len(ew) + 1), lambda i: list_transform(range(i, len(ew) + 1), lambda e: array_to_string(ew[i:e], '')))), array_to_string(vw, '')) AS supported FROM a)
SELECT p_partkey, value, evidence, coalesce(supported, FALSE) AS supported FROM r""")
def string_runs(spark, sf_dir):
    """Names, parts of names and parts of words against what a page says: whole words in order count,
    whatever their case and punctuation."""
    from factloom.operators.values import checked_strings

    w, k, j = F.split("p_name", " "), F.col("p_partkey") % 5, F.floor(F.col("p_partkey") / 5) % 4
    at = lambda i: F.get(w, F.lit(i))
    value = F.when(j == 0, F.col("p_name")).when(j == 1, F.concat(F.upper(at(0)), F.lit("-"), at(1))).when(j == 2, F.concat(at(0), F.lit(" "), at(2))).otherwise(F.substring(at(0), 1, 2))
    said = F.lit(None).cast("string")
    for i, (frame, _) in enumerate(_SAID):
        before, after = frame.split("{}")
        said = F.when(k == i, F.concat(F.lit(before), "p_name", F.lit(after))).otherwise(said)
    rows = table(spark, sf_dir, "part").select("p_partkey", value.alias("value"), said.alias("evidence"))
    told = checked_strings(rows.select("*", F.col("value").alias("_v"), F.col("evidence").alias("_e")), "_v", "_e")
    return told.select("p_partkey", "value", "evidence", "supported")


@query("""
WITH f AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 4 END AS page FROM lineitem),
r AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'missing' ELSE 'all' END AS mode, CASE WHEN o_orderkey % 4 < 2 THEN 'reader 5; eng; 144 dpi' END AS engine, CASE WHEN o_orderkey % 4 = 0 THEN [1, 3] END AS pages FROM orders WHERE o_orderkey % 10 <> 0)
SELECT doc_id, n, page, CASE WHEN mode <> 'native' OR engine IS NOT NULL THEN mode END AS text_mode, CASE WHEN mode <> 'native' OR engine IS NOT NULL THEN CASE WHEN page IS NULL THEN 'Unlocated evidence' WHEN engine IS NOT NULL AND (pages IS NULL OR list_contains(pages, page)) THEN 'OCR: ' || engine ELSE 'Native PDF text' END END AS text_source FROM f LEFT JOIN r USING (doc_id)""")
def export_provenance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 4).alias("page"))
    k = F.col("o_orderkey")
    mode = F.when(k % 3 == 0, "native").when(k % 3 == 1, "missing").otherwise("all")
    told = table(spark, sf_dir, "orders").where(k % 10 != 0).select(k.alias("doc_id"), mode.alias("text_mode"), F.when(k % 4 < 2, "reader 5; eng; 144 dpi").alias("engine"), F.when(k % 4 == 0, F.array(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("processed_pages"))
    return R.with_provenance(rows, told)


@query("""
WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, l_linenumber, l_partkey, CASE l_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS mode, CASE l_partkey % 3 WHEN 0 THEN 'contributes' WHEN 1 THEN 'no_contribution' END AS state FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, l_linenumber, l_partkey ORDER BY mode, state) AS rn FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY l_linenumber, l_partkey) - 1 AS word_no FROM d WHERE rn = 1)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(word_no AS INTEGER) AS word_no, 'w' || l_partkey AS text, l_linenumber * 10.0::DOUBLE AS x0, coalesce(mode = 3, FALSE) OR coalesce(state = 'no_contribution', FALSE) OR (mode IS NOT NULL AND state IS NULL) AS review_paint FROM o""")
def document_json_words(spark, sf_dir):
    """Orders written as document JSON of two pages, and read again."""
    from factloom.sources.readers import document_words

    part, line = F.col("l_partkey"), F.col("l_linenumber")
    x = line * F.lit(10.0)
    box = F.struct(x.alias("x0"), F.lit(0.0).alias("top"), (x + 9).alias("x1"), F.lit(10.0).alias("bottom"))
    word = F.struct(F.concat(F.lit("w"), part.cast("string")).alias("text"), box.alias("bbox"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(part % 4 == 0, 3).when(part % 4 == 1, 0).alias("render_mode"), F.when(part % 3 == 0, "contributes").when(part % 3 == 1, "no_contribution").alias("raster_state"))
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (line % 2 + 1).alias("number"), "l_linenumber", "l_partkey").agg(F.first(word).alias("word"))
    pages = one.groupBy("l_orderkey", "number").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "word"))), lambda s: s["word"]).alias("words"))
    docs = pages.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("number", "words"))).alias("pages"))
    return document_words(docs.select(F.col("l_orderkey").alias("doc_id"), F.to_json(F.struct(F.lit("s").alias("source"), "pages")).alias("json"))).select("doc_id", "page", "word_no", "text", "x0", "review_paint")


@query("""
WITH b AS (SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE ELSE event_id % 50 END AS x0, CASE WHEN event_id % 6 = 3 THEN NULL ELSE 10.0 END::DOUBLE AS top, CASE WHEN event_id % 6 = 4 THEN (event_id % 50)::DOUBLE ELSE event_id % 50 + 5 END AS x1, 20.0::DOUBLE AS bottom FROM events)
SELECT event_id % 6 AS kind, coalesce(isfinite(x0) AND isfinite(top) AND isfinite(x1) AND x1 > x0 AND bottom > top, FALSE) AS sound, count(*) AS n FROM b GROUP BY 1, 2""")
def sound_boxes(spark, sf_dir):
    e = F.col("event_id")
    x0 = F.when(e % 6 == 1, float("nan")).when(e % 6 == 2, float("-inf")).otherwise((e % 50).cast("double"))
    x1 = (e % 50 + F.when(e % 6 == 4, 0).otherwise(5)).cast("double")
    ok = C.sound_box(x0, F.when(e % 6 != 3, 10.0), x1, F.lit(20.0))
    return table(spark, sf_dir, "events").groupBy((e % 6).alias("kind"), ok.alias("sound")).agg(F.count("*").alias("n"))


@query("""
WITH p AS (SELECT p_partkey, 10.0::DOUBLE AS l, 20.0::DOUBLE AS b, CASE WHEN p_partkey % 9 = 0 THEN 10 ELSE 110 END::DOUBLE AS r, 220.0::DOUBLE AS t, p_size * 2.0::DOUBLE AS x, p_size * 3.0::DOUBLE AS y FROM part)
SELECT p_partkey, CASE WHEN r > l THEN round(300 + (x - l) / (r - l) * 0 + (y - b) / (t - b) * -300, 6) END AS dx, CASE WHEN r > l THEN round(5 + (x - l) / (r - l) * 150 + (y - b) / (t - b) * 0, 6) END AS dy, sha256('part|' || p_partkey || '|' || p_size) AS seed, '/a~0b/' || replace(replace(p_type, '~', '~0'), '/', '~1') || '/c~1d' AS pointer FROM part p2 JOIN p USING (p_partkey)""")
def mapped_points(spark, sf_dir):
    """Points of a page turned by a quarter, seeds of random streams and JSON Pointers."""
    lit = lambda v: F.lit(float(v))
    box = (lit(10), lit(20), F.when(F.col("p_partkey") % 9 == 0, lit(10)).otherwise(lit(110)), lit(220))
    at = C.mapped_point(F.col("p_size") * lit(2), F.col("p_size") * lit(3), box, (lit(300), lit(5)), (lit(300), lit(155)), (lit(0), lit(5)))
    rows = table(spark, sf_dir, "part").select("p_partkey", at.alias("at"), C.seed_of(F.lit("part"), F.col("p_partkey"), F.col("p_size")).alias("seed"), C.json_pointer(F.array(F.lit("a~b"), "p_type", F.lit("c/d"))).alias("pointer"))
    return rows.select("p_partkey", F.round("at.x", 6).alias("dx"), F.round("at.y", 6).alias("dy"), "seed", "pointer")


@query("""
WITH n AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 0 ELSE n_chars END AS n_words FROM documents), r AS (SELECT doc_id, n_chars AS n_words FROM documents WHERE lang <> 'de')
SELECT 'all' AS mode, 'recognised' AS text_source, count(*) AS n, CAST(sum(n_words) AS BIGINT) AS words FROM r UNION ALL SELECT 'native', 'native', count(*), CAST(sum(n_words) AS BIGINT) FROM n
UNION ALL SELECT 'missing', 'native', count(*), CAST(sum(n_words) AS BIGINT) FROM n WHERE n_words > 0 UNION ALL SELECT 'missing', 'recognised', count(*), CAST(sum(r.n_words) AS BIGINT) FROM r JOIN n USING (doc_id) WHERE n.n_words = 0 HAVING count(*) > 0""")
def text_modes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    native = docs.select("doc_id", F.when(F.col("n_chars") < 300, 0).otherwise(F.col("n_chars")).cast("long").alias("n_words"))
    seen = docs.where("lang <> 'de'").select("doc_id", F.col("n_chars").cast("long").alias("n_words"))
    out = None
    for mode in ("native", "missing", "all"):
        part = R.native_or_recognised(native, seen, ["doc_id"], mode).select(F.lit(mode).alias("mode"), "text_source", "n_words")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("mode", "text_source").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))


@query("""
WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 270 ELSE 45 END AS turn, p_size AS l, p_size * 2 AS b, 600 - p_size AS r, 800 - p_size * 3 AS t FROM part)
SELECT p_partkey, CAST(CASE turn WHEN 0 THEN l - 1 WHEN 90 THEN b - 2 WHEN 180 THEN 612 - r WHEN 270 THEN 812 - t END AS DOUBLE) AS x, CAST(CASE turn WHEN 0 THEN 812 - t WHEN 90 THEN l - 1 WHEN 180 THEN b - 2 WHEN 270 THEN 612 - r END AS DOUBLE) AS y, CAST(CASE WHEN turn IN (0, 180) THEN r - l WHEN turn IN (90, 270) THEN t - b END AS DOUBLE) AS width, CAST(CASE WHEN turn IN (0, 180) THEN t - b WHEN turn IN (90, 270) THEN r - l END AS DOUBLE) AS height FROM p""")
def visible_boxes(spark, sf_dir):
    k, size = F.col("p_partkey") % 5, F.col("p_size")
    turn = F.when(k == 0, 0).when(k == 1, 90).when(k == 2, 180).when(k == 3, 270).otherwise(45)
    box = C.visible_box(turn, tuple(F.lit(v) for v in (1, 2, 612, 812)), (size, size * 2, 600 - size, 800 - size * 3))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


@query("""
WITH b AS (SELECT event_id, (event_id % 100)::DOUBLE AS x0, (event_id % 70)::DOUBLE AS y0, (event_id % 100 + 20)::DOUBLE AS x1, (event_id % 70 + 8)::DOUBLE AS y1, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 10 ELSE 0 END::DOUBLE AS c0, CASE WHEN event_id % 4 = 3 THEN 90.0000005 ELSE 100 END::DOUBLE AS c2, CASE WHEN event_id % 8 = 6 THEN 0 ELSE 60 END::DOUBLE AS c3 FROM events)
SELECT event_id % 8 AS kind, CASE WHEN c0 IS NULL THEN FALSE WHEN c0 >= c2 OR 0 >= c3 THEN TRUE ELSE x0 < c0 - 1e-6 OR y0 < 0 - 1e-6 OR x1 > c2 + 1e-6 OR y1 > c3 + 1e-6 END AS crosses, count(*) AS n FROM b GROUP BY 1, 2""")
def clip_risks(spark, sf_dir):
    e = F.col("event_id")
    left = F.when(e % 4 == 0, F.lit(None)).when(e % 4 == 1, 10.0).otherwise(0.0)
    known = left.isNotNull()
    clip = tuple(F.when(known, x) for x in (left, F.lit(0.0), F.when(e % 4 == 3, 90.0000005).otherwise(100.0), F.when(e % 8 == 6, 0.0).otherwise(60.0)))
    box = tuple((x).cast("double") for x in (e % 100, e % 70, e % 100 + 20, e % 70 + 8))
    return table(spark, sf_dir, "events").groupBy((e % 8).alias("kind"), C.crosses_clip(box, clip).alias("crosses")).agg(F.count("*").alias("n"))
