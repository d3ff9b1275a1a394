"""Driver queries of field rules, row evidence and study tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C
from factloom.operators import relational as R
from factloom.plans.catalog import _COUNTERS, _OUTCOME_SQL, _counters, _money, _outcomes, _tokens, query, table

_PATHS = ("issueDate", "line_items[3].due_date", "candidate", "updates[0]", "birthdates[2]", "order2date", "totalDATE", "dates.vendor", '["due date"]', 'rows[1]["a[2].b"].cells[4].value', '["x[9].y"]')
_PATHS_SQL = "(SELECT unnest([" + ", ".join(f"'{p}'" for p in _PATHS) + "]) AS path)"
_NAMES_SQL = f"WITH p AS (SELECT n_nationkey, path FROM nation, {_PATHS_SQL})"


def _paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.array(*map(F.lit, _PATHS))).alias("path"))


@query(_NAMES_SQL + r""", m AS (SELECT *, regexp_extract(path, '(?:\["((?:[^"\\]|\\.)*)"\]|([^.\[\]]+))(?:\[\d+\])*$', 1) || regexp_extract(path, '(?:\["((?:[^"\\]|\\.)*)"\]|([^.\[\]]+))(?:\[\d+\])*$', 2) AS member FROM p)
SELECT path, list_has_any(regexp_split_to_array(lower(regexp_replace(member, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z]+'), ['date', 'dates', 'birthdate', 'birthdates']) AS hint, count(*) AS n FROM m GROUP BY 1, 2""")
def date_name_hint(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("path", C.hints_date(F.col("path")).alias("hint")).agg(F.count("*").alias("n"))


@query(_NAMES_SQL + r"""
SELECT path, nullif(regexp_extract(path, '^((?:"(?:[^"\\]|\\.)*"|[^"])*\[\d+\])\.', 1), '') AS row_prefix, count(*) AS n FROM p GROUP BY 1, 2""")
def row_prefixes(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("path", C.row_prefix(F.col("path")).alias("row_prefix")).agg(F.count("*").alias("n"))


_TYPED = ("12.5", " 7. ", ".5", "1e3", "1,000", "$5", "true", " false ", "TRUE", "", "-0.25", "1e999", "4 5")


@query(r"""
WITH t AS (SELECT r_regionkey, kind, typed FROM region, (SELECT unnest(['number', 'boolean', 'text']) AS kind), (SELECT unnest([""" + ", ".join(f"'{x}'" for x in _TYPED) + r"""]) AS typed)),
p AS (SELECT *, CASE WHEN kind = 'number' AND regexp_matches(trim(typed), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') AND typed <> '1e999' THEN CAST(trim(typed) AS DOUBLE) END AS number FROM t)
SELECT r_regionkey, kind, typed, CASE kind WHEN 'number' THEN number IS NOT NULL WHEN 'boolean' THEN trim(typed) IN ('true', 'false') ELSE TRUE END AS accepted, number FROM p""")
def edit_values(spark, sf_dir):
    kinds, typed = (F.explode(F.array(*map(F.lit, x))) for x in (("number", "boolean", "text"), _TYPED))
    rows = table(spark, sf_dir, "region").select("r_regionkey", kinds.alias("kind")).select("*", typed.alias("typed"))
    return rows.withColumn("e", C.edit_value(F.col("kind"), F.col("typed"))).select("r_regionkey", "kind", "typed", "e.accepted", "e.number")


@query("""
WITH p AS (SELECT CASE WHEN p_partkey % 51 = 0 THEN 'nan'::DOUBLE WHEN p_partkey % 53 = 0 THEN 'inf'::DOUBLE ELSE CAST(p_retailprice AS DOUBLE) END AS w, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE p_size * 25.5 END::DOUBLE AS h FROM part)
SELECT CASE WHEN isfinite(w) AND w > 0 AND isfinite(h) AND h > 0 THEN CASE WHEN ceil(w * 2) * ceil(h * 2) > 4000000 THEN 'too_large' ELSE 'ok' END ELSE 'bad_dimensions' END AS verdict, count(*) AS n FROM p GROUP BY 1""")
def page_limits(spark, sf_dir):
    k = F.col("p_partkey")
    width = F.when(k % 51 == 0, float("nan")).when(k % 53 == 0, float("inf")).otherwise(F.col("p_retailprice").cast("double"))
    height = F.when(k % 50 == 0, 0.0).otherwise(F.col("p_size") * F.lit(25.5))
    return table(spark, sf_dir, "part").groupBy(C.page_limit(width, height, 2.0, 4_000_000).alias("verdict")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT event_id % 41 + 60.0 AS score, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS agree, event_id % 5 = 0 AS by_value FROM events)
SELECT score >= 100 AND NOT by_value AS is_exact, coalesce(agree, score >= 92) AS is_strong, count(*) AS n FROM m GROUP BY 1, 2""")
def match_strengths(spark, sf_dir):
    e = F.col("event_id")
    s = C.match_strength((e % 41 + 60).cast("double"), F.when(e % 3 == 0, True).when(e % 3 == 1, False), e % 5 == 0)
    return table(spark, sf_dir, "events").select(s.alias("s")).groupBy("s.is_exact", "s.is_strong").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- rows


@query("""
WITH c AS (SELECT user_id AS doc_id, event_id AS ord, event_id % 4 AS page, CAST(event_id * 37 % 800 AS DOUBLE) AS top FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page <> doc_id % 4, abs(top - doc_id % 800), ord) AS rn FROM c)
SELECT doc_id, ord, page, top FROM r WHERE rn = 1""")
def nearest_candidates(spark, sf_dir):
    e, doc = F.col("event_id"), F.col("user_id")
    found = table(spark, sf_dir, "events").select(doc.alias("doc_id"), e.alias("ord"), (e % 4).alias("page"), (e * 37 % 800).cast("double").alias("top"))
    hints = found.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 4).alias("page"), (F.col("doc_id") % 800).cast("double").alias("top"))
    return R.nearest_candidates(found, hints, "doc_id")


@query("""
WITH f AS (SELECT user_id AS doc_id, event_type AS row_prefix, event_id AS field_no, event_type || '.f' || CAST(event_id AS VARCHAR) AS path, value < 60 AND event_id % 3 <> 0 AND event_id % 7 <> 0 AS able FROM events)
SELECT doc_id, path, first_value(CASE WHEN able THEN path END IGNORE NULLS) OVER (PARTITION BY doc_id, row_prefix ORDER BY field_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS anchor_path FROM f""")
def row_anchors(spark, sf_dir):
    e = F.col("event_id")
    fields = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("row_prefix"), e.alias("field_no"), F.concat("event_type", F.lit(".f"), e.cast("string")).alias("path"),
        F.when(F.col("value") < 60, "verified").otherwise("needs_review").alias("status"), (e % 3 != 0).alias("is_strong"), F.when(e % 7 == 0, 1).otherwise(0).alias("n_notes"),
    )
    return R.row_anchors(fields, "doc_id", "row_prefix").select("doc_id", "path", "anchor_path")


@query("""
WITH f AS (SELECT event_id AS i, event_id % 11 <> 0 AS extracted, event_id % 7 <> 0 AS trusted, event_id % 5 <> 0 AS supported, event_id % 3 AS page, CAST(event_id * 13 % 40 AS DOUBLE) AS top,
  CAST(event_id * 13 % 40 AS DOUBLE) + CASE WHEN event_id % 17 = 0 THEN 0 ELSE 10 END AS bottom, CASE WHEN event_id % 23 <> 0 THEN event_id % 2 END AS a_page, CAST(event_id * 7 % 40 AS DOUBLE) AS a_top, CAST(event_id * 7 % 40 AS DOUBLE) + 12 AS a_bottom FROM events),
r AS (SELECT CASE WHEN NOT extracted THEN 'not_extracted' WHEN NOT trusted OR a_page IS NULL THEN 'anchor_untrusted' WHEN NOT supported THEN 'field_unsupported' WHEN page <> a_page THEN 'other_page'
  WHEN bottom <= top THEN 'bad_geometry' WHEN least(bottom, a_bottom) - greatest(top, a_top) > 0 AND least(bottom, a_bottom) - greatest(top, a_top) >= least(bottom - top, a_bottom - a_top) / 2 THEN 'one_line' ELSE 'other_line' END AS row_reason FROM f)
SELECT row_reason, CASE WHEN row_reason = 'one_line' THEN 'same_line' WHEN row_reason IN ('other_page', 'other_line') THEN 'separate' ELSE 'unavailable' END AS row_status, count(*) AS n FROM r GROUP BY 1, 2""")
def row_checks(spark, sf_dir):
    e = F.col("event_id")
    top, a_top = (e * 13 % 40).cast("double"), (e * 7 % 40).cast("double")
    pairs = table(spark, sf_dir, "events").select(
        (e % 11 != 0).alias("extracted"), (e % 7 != 0).alias("anchor_trusted"), (e % 5 != 0).alias("field_supported"),
        (e % 3).alias("page"), top.alias("top"), (top + F.when(e % 17 == 0, 0).otherwise(10)).alias("bottom"), F.lit(0.0).alias("x0"), F.lit(9.0).alias("x1"),
        F.when(e % 23 != 0, e % 2).alias("a_page"), a_top.alias("a_top"), (a_top + 12).alias("a_bottom"), F.lit(20.0).alias("a_x0"), F.lit(30.0).alias("a_x1"),
    )
    return R.row_check(pairs).groupBy("row_reason", "row_status").agg(F.count("*").alias("n"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
w AS (SELECT l_orderkey, l_partkey * 1000000 + l_suppkey AS word_id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
SELECT l_orderkey, CAST(price * 100 AS BIGINT) AS quote_id, count(DISTINCT word_id) AS n_places FROM l JOIN w USING (l_orderkey, price) GROUP BY 1, 2""")
def by_value_places(spark, sf_dir):
    read = F.transform(C.number_readings(F.col("token")), lambda r: r["value"].cast("decimal(18,2)"))
    quotes = _tokens(spark, sf_dir).where("spelling = 0").select("l_orderkey", (F.col("price") * 100).cast("long").alias("quote_id"), read.alias("readings")).distinct()
    lines = table(spark, sf_dir, "lineitem")
    whole, cents = F.floor(_money("l_extendedprice")).cast("long"), F.lpad(F.pmod((_money("l_extendedprice") * 100).cast("long"), F.lit(100)).cast("string"), 2, "0")
    token = F.concat(F.replace(F.format_string("%,d", whole), F.lit(","), F.lit(".")), F.lit(","), cents)
    words = lines.select("l_orderkey", (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("word_id"), token.alias("token")).select("l_orderkey", "word_id", read.alias("readings"))
    return R.by_value(quotes, words, "l_orderkey").groupBy("l_orderkey", "quote_id").agg(F.count("*").alias("n_places"))


# ---------------------------------------------------------------- sources, reports, studies


@query("""
WITH n AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 0 ELSE n_chars END AS n_words, lang FROM documents), r AS (SELECT doc_id, n_chars AS n_words, lang FROM documents WHERE lang <> 'de')
SELECT doc_id, n_words, 'native' AS text_source FROM n WHERE n_words > 0 UNION ALL SELECT r.doc_id, r.n_words, 'recognised' FROM r JOIN n USING (doc_id) WHERE n.n_words = 0""")
def native_or_recognised(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    native = docs.select("doc_id", F.when(F.col("n_chars") < 300, 0).otherwise(F.col("n_chars")).cast("long").alias("n_words"))
    seen = docs.where("lang <> 'de'").select("doc_id", F.col("n_chars").cast("long").alias("n_words"))
    return R.native_or_recognised(native, seen, ["doc_id"])


@query("""
WITH w AS (SELECT user_id AS doc_id, event_id % 3 AS page, event_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS word, event_id % 500 / 2.0 AS x0 FROM events),
k AS (SELECT *, row_number() OVER p - 1 AS word_no, coalesce(sum(length(word) + 1) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w WHERE word <> '' WINDOW p AS (PARTITION BY doc_id, page ORDER BY event_id))
SELECT doc_id, page, word_no, word AS text, CAST(s AS BIGINT) AS start, CAST(s + length(word) AS BIGINT) AS stop, CAST(x0 AS DOUBLE) AS x0 FROM k""")
def recognised_offsets(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 6 == 0, " \t").otherwise(F.concat(F.lit(" "), "event_type", F.lit("\n")))
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (e % 3).alias("page"), "event_id", text.alias("text"), ((e % 500).cast("double") / 2).alias("x0"))
    return R.word_offsets(words, ["doc_id", "page"], "event_id").select("doc_id", "page", "word_no", "text", "start", "stop", "x0")


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN repeat(' ', length(x)) ELSE x END), ' ') AS text FROM w""")
def convention_texts(spark, sf_dir):
    words = F.transform(F.filter(F.split("text", R.SPACE), lambda w: w != ""), lambda w: F.struct(w.alias("text"), w.rlike("[0-9]").alias("review")))
    return table(spark, sf_dir, "documents").select("doc_id", C.convention_text(words).alias("text"))


@query("""
WITH v AS (SELECT c_mktsegment AS kind, c_nationkey AS doc, c_custkey AS value FROM customer),
p AS (SELECT a.kind, a.doc, b.doc AS other_doc, b.value AS other_value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.kind, a.doc) AS n FROM (SELECT DISTINCT kind, doc FROM v) a JOIN v b ON a.kind = b.kind AND a.doc <> b.doc WINDOW w AS (PARTITION BY a.kind, a.doc ORDER BY b.doc, b.value))
SELECT kind, doc, other_doc, other_value FROM p WHERE i % greatest(1, n // 200) = 0""")
def other_documents(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("value"))
    return R.other_documents(values, ["kind"], "doc", 200)


@query("""
WITH f AS (SELECT user_id AS doc_id, event_type || CAST(event_id % 5 AS VARCHAR) AS path, CASE event_id % 9 WHEN 0 THEN 'maybe' WHEN 1 THEN NULL WHEN 2 THEN 'unsupported' ELSE 'verified' END AS status, event_id % 8 AS page FROM events)
SELECT doc_id, count(*) - count(DISTINCT path) AS n_repeated_paths, count(*) FILTER (coalesce(status, '') NOT IN ('verified', 'needs_review', 'unsupported')) AS n_bad_status, count(*) FILTER (page < 1 OR page > 6) AS n_bad_page FROM f GROUP BY 1""")
def report_problems(spark, sf_dir):
    e = F.col("event_id")
    status = F.when(e % 9 == 0, "maybe").when(e % 9 == 1, F.lit(None)).when(e % 9 == 2, "unsupported").otherwise("verified")
    fields = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.concat("event_type", (e % 5).cast("string")).alias("path"), status.alias("status"), (e % 8).alias("page"), F.lit(6).alias("n_pages"))
    return R.report_problems(fields, "doc_id", ["verified", "needs_review", "unsupported"])


@query("SELECT event_type, CAST(round(median(value), 4) AS DOUBLE) AS median_value, min(value) AS least_value, count(value) AS n FROM events GROUP BY 1")
def run_medians(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 4).alias("median_value"), F.min("value").alias("least_value"), F.count("value").alias("n"))


@query(_OUTCOME_SQL + f"SELECT {_COUNTERS} FROM o WHERE kind IN ('A', 'R') AND variant = 'F' AND present")
def outcome_totals(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).where(F.col("kind").isin("A", "R") & (F.col("variant") == "F") & F.col("present"))
    return rows.agg(*_counters())


@query("""
WITH t AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_orderkey AS doc, l_linenumber % 4 AS k, l_quantity > 25 AS accepted FROM lineitem),
f AS (SELECT CASE WHEN k = 0 THEN 'zero' WHEN k = 1 AND price >= 1000 THEN 'dot_thousands' WHEN k = 2 AND price >= 1000 THEN 'comma_thousands' ELSE 'plain' END AS form, doc, accepted FROM t)
SELECT form, count(*) AS n, count(*) FILTER (accepted) AS n_accepted, count(DISTINCT doc) AS docs FROM f GROUP BY 1""")
def thousands_forms(spark, sf_dir):
    k, whole = F.col("l_linenumber") % 4, F.format_string("%,d", F.floor(_money("l_extendedprice")).cast("long"))
    token = F.when(k == 0, "0").when(k == 1, F.replace(whole, F.lit(","), F.lit("."))).when(k == 2, whole).otherwise(F.replace(whole, F.lit(","), F.lit("")))
    form = F.when(token == "0", "zero").when(F.contains(token, F.lit(".")), "dot_thousands").when(F.contains(token, F.lit(",")), "comma_thousands").otherwise("plain")
    rows = table(spark, sf_dir, "lineitem").select(form.alias("form"), F.col("l_orderkey").alias("doc"), (F.col("l_quantity") > 25).alias("accepted"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n_accepted"), F.countDistinct("doc").alias("docs"))
