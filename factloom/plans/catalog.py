"""Driver queries of the verification operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import columns as C
from factloom.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(c: str):
    return F.col(c).cast("decimal(18,2)")


# ---------------------------------------------------------------- location


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def ground_exact(spark, sf_dir):
    return R.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH p AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))
SELECT b.item_id, count(p.doc_id) AS n_places,
  CASE count(p.doc_id) WHEN 0 THEN 'unsupported' WHEN 1 THEN 'verified' ELSE 'needs_review' END AS status
FROM benchmark b LEFT JOIN p USING (item_id) GROUP BY 1""")
def ground_ambiguity(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark")
    return R.location_verdicts(R.containing(table(spark, sf_dir, "documents"), passages), passages)


@query("""
WITH p AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), s AS (
  SELECT b.item_id, CASE count(p.doc_id) WHEN 0 THEN 'unsupported' WHEN 1 THEN 'verified' ELSE 'needs_review' END AS status
  FROM benchmark b LEFT JOIN p USING (item_id) GROUP BY 1)
SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'needs_review') AS needs_review,
  count(*) FILTER (status = 'unsupported') AS unsupported FROM s""")
def report_counts(spark, sf_dir):
    return R.report_counts(ground_ambiguity(spark, sf_dir))


@query(r"""
WITH q AS (SELECT item_id, max_by(w, (length(w), w)) AS quote FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) AS w FROM benchmark) GROUP BY 1),
c AS (SELECT d.doc_id, q.item_id, d.text, q.quote FROM documents d JOIN q ON contains(d.text, q.quote)),
p AS (SELECT doc_id, item_id, text, quote, unnest(range(1, length(text) + 1)) AS i FROM c)
SELECT doc_id, item_id, count(*) AS n FROM p WHERE substr(text, i, length(quote)) = quote GROUP BY 1, 2""")
def ground_occurrences(spark, sf_dir):
    words = F.filter(F.split("text", R.SPACE), lambda w: w != "")
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return R.occurrences_in_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", longest.alias("quote")))


_WORDS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '') AS ws FROM documents),
flat AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS word_no, unnest(ws) AS word FROM w)
"""


@query(_WORDS_SQL + """, o AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM flat)
SELECT doc_id, CAST(word_no AS BIGINT) AS word_no, word, CAST(s AS BIGINT) AS start, CAST(s + length(word) AS BIGINT) AS stop FROM o""")
def page_words(spark, sf_dir):
    return R.page_words(table(spark, sf_dir, "documents"))


@query(_WORDS_SQL + "SELECT doc_id, word, count(*) AS n FROM flat GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_words(spark, sf_dir):
    words = F.filter(F.split("text", R.SPACE), lambda w: w != "")
    flat = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("word"))
    return flat.groupBy("doc_id", "word").agg(F.count("*").alias("n")).where("n > 1")


@query(r"""
WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\n') AS ls FROM documents),
f AS (SELECT doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line FROM l),
w AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \t\r\f\x0B]+'), lambda x: x <> '') AS ws FROM f),
x AS (SELECT doc_id, line_no, generate_subscripts(ws, 1) AS word_no, unnest(ws) AS word FROM w),
y AS (SELECT *, lag(word, 1) OVER p AS before1, lag(word, 2) OVER p AS before2 FROM x WINDOW p AS (PARTITION BY doc_id, line_no ORDER BY word_no))
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, CAST(word_no AS BIGINT) AS word_no, word, before1, before2 FROM y WHERE regexp_matches(word, '^[0-9]')""")
def label_before(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("doc_id", F.col("line_no") + 1, F.posexplode(F.filter(F.split("line", r"[ \t\r\f\x0B]+"), lambda w: w != "")).alias("word_no", "word")).toDF("doc_id", "line_no", "word_no", "word")
    w = Window.partitionBy("doc_id", "line_no").orderBy("word_no")
    out = words.select("doc_id", F.col("line_no").cast("long").alias("line_no"), (F.col("word_no") + 1).cast("long").alias("word_no"), "word", F.lag("word", 1).over(w).alias("before1"), F.lag("word", 2).over(w).alias("before2"))
    return out.where(F.col("word").rlike("^[0-9]"))


# ---------------------------------------------------------------- numbers and dates

_TOKENS_SQL = """
WITH base AS (SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
parts AS (SELECT *, CAST(floor(price) AS BIGINT) AS whole, CAST(price * 100 AS BIGINT) % 100 AS cents FROM base)
"""


def _tokens(spark, sf_dir) -> DataFrame:
    """The lines' prices in four spellings."""
    price = _money("l_extendedprice")
    grouped, cents = F.format_string("%,d", F.floor(price).cast("long")), F.lpad((F.pmod((price * 100).cast("long"), F.lit(100))).cast("string"), 2, "0")
    dotted = F.replace(grouped, F.lit(","), F.lit("."))
    whole = F.floor(price).cast("long").cast("string")
    spelt = F.array(F.concat(grouped, F.lit("."), cents), F.concat(dotted, F.lit(","), cents), F.concat(whole, F.lit("."), cents), F.concat(whole, F.lit(","), cents))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", price.alias("price"), F.posexplode(spelt).alias("spelling", "token"))
    return rows


_SPELT_SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(floor(l_extendedprice) AS BIGINT) AS whole, CAST(l_quantity AS BIGINT) AS q, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) % 100 AS cents, l_orderkey + l_linenumber AS k FROM lineitem),
t AS (SELECT *, lpad(CAST(cents AS VARCHAR), 2, '0') AS c2, format('{:,}', whole) AS g FROM l),
s AS (SELECT *, CASE k % 12 WHEN 0 THEN g || '.' || c2 WHEN 1 THEN replace(g, ',', '.') || ',' || c2 WHEN 2 THEN CAST(q AS VARCHAR) || '.00' WHEN 3 THEN CAST(q AS VARCHAR) || ',5' WHEN 4 THEN replace(g, ',', '.') WHEN 5 THEN g
  WHEN 6 THEN CAST(whole AS VARCHAR) || '.' || c2 WHEN 7 THEN replace(g, ',', '.') || '.000.000' WHEN 8 THEN g || '.' || c2 || '0' WHEN 9 THEN CAST(whole AS VARCHAR) || ',' || c2 WHEN 10 THEN '12,34,567.' || c2 ELSE '.' || c2 END AS token FROM t)
"""
_STYLE_SQL = r"""CASE WHEN regexp_full_match(token, '[0-9]{1,3}(,[0-9]{3})+\.[0-9]{1,2}') THEN 'decimal' WHEN regexp_full_match(token, '[0-9]{1,3}(\.[0-9]{3}){2,}|[0-9]{1,3}(\.[0-9]{3})+,[0-9]{1,2}') THEN 'thousands' END"""


def _spelt(spark, sf_dir) -> DataFrame:
    """The lines' prices and quantities in twelve spellings, most of which prove no convention."""
    price = _money("l_extendedprice")
    whole, q, k = F.floor(price).cast("long"), F.col("l_quantity").cast("long").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 12
    grouped, cents = F.format_string("%,d", whole), F.lpad(F.pmod((price * 100).cast("long"), F.lit(100)).cast("string"), 2, "0")
    dotted, said, plain = F.replace(grouped, F.lit(","), F.lit(".")), F.lit("."), whole.cast("string")
    forms = [F.concat(grouped, said, cents), F.concat(dotted, F.lit(","), cents), F.concat(q, F.lit(".00")), F.concat(q, F.lit(",5")), dotted, grouped, F.concat(plain, said, cents), F.concat(dotted, F.lit(".000.000")), F.concat(grouped, said, cents, F.lit("0")), F.concat(plain, F.lit(","), cents), F.concat(F.lit("12,34,567."), cents), F.concat(said, cents)]
    token = F.when(k == 0, forms[0])
    for i, form in enumerate(forms[1:], 1):
        token = token.when(k == i, form)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k.alias("form"), token.alias("token"))


@query(_SPELT_SQL + r""", r AS (SELECT k % 12 AS form, token, CASE
  WHEN regexp_full_match(token, '[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[0-9]{1,2}(,[0-9]{2})+,[0-9]{3}(\.[0-9]+)?') THEN replace(token, ',', '')
  WHEN regexp_full_match(token, '[0-9]{1,3}(\.[0-9]{3})+,[0-9]{1,2}|[0-9]{1,3}(\.[0-9]{3}){2,}') THEN replace(replace(token, '.', ''), ',', '.')
  WHEN regexp_full_match(token, '[0-9]*,[0-9]{1,2}') THEN replace(token, ',', '.')
  WHEN regexp_full_match(token, '[0-9]+(\.[0-9]+)?|\.[0-9]+') THEN token END AS first_value, regexp_full_match(token, '[1-9][0-9]{0,2}\.[0-9]{3}') AS two FROM s)
SELECT form, count(*) AS n, count(first_value) AS n_read, count(*) FILTER (two) AS n_undecided, CAST(sum(CAST(first_value AS DECIMAL(28,4))) AS DOUBLE) AS total FROM r GROUP BY 1""")
def number_parse_styles(spark, sf_dir):
    rows = _spelt(spark, sf_dir).select("form", C.number_readings(F.col("token")).alias("r"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.count_if(F.size("r") > 0).alias("n_read"), F.count_if(F.size("r") == 2).alias("n_undecided"), F.sum(F.get("r", F.lit(0))["value"].cast("decimal(28,4)")).cast("double").alias("total"))


@query(_TOKENS_SQL + """
, t AS (SELECT price, d, price + CASE WHEN d = 2 THEN 0.005 ELSE CAST(d AS DECIMAL(6,3)) * 0.01 END AS claim FROM parts, (SELECT unnest([-1, 0, 1, 2]) AS d))
SELECT d AS shift, CASE WHEN abs(claim - price) <= 0.005 THEN 'supported' ELSE 'unsupported' END AS verdict, count(*) AS n FROM t GROUP BY 1, 2""")
def number_check(spark, sf_dir):
    # a token is read once for all claims about it
    rows = _tokens(spark, sf_dir).where("spelling = 0").select("price", C.number_readings(F.col("token")).alias("r"))
    rows = rows.select("price", "r", F.explode(F.array(*(F.lit(x) for x in (-1, 0, 1, 2)))).alias("shift"))
    claim = F.col("price").cast("decimal(20,3)") + F.when(F.col("shift") == 2, F.lit("0.005").cast("decimal(20,3)")).otherwise(F.col("shift").cast("decimal(20,3)") / 100).cast("decimal(20,3)")
    return rows.select("shift", C.check_number(claim, F.col("r")).alias("verdict")).groupBy("shift", "verdict").agg(F.count("*").alias("n"))


@query(_SPELT_SQL + f"""
, p AS (SELECT l_orderkey, {_STYLE_SQL} AS style FROM s), o AS (SELECT l_orderkey, count(DISTINCT style) AS n, min(style) AS one FROM p GROUP BY 1)
SELECT l_orderkey, n AS n_styles, CASE WHEN n = 1 THEN one WHEN n = 0 THEN 'decimal' END AS style FROM o""")
def number_style_by_order(spark, sf_dir):
    rows = _spelt(spark, sf_dir).select("l_orderkey", C.number_style(F.col("token")).alias("style"))
    found = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("style")).alias("s"))
    return found.select("l_orderkey", F.size("s").cast("long").alias("n_styles"), C.settled(F.col("s"), F.lit("decimal")).alias("style"))


_AROUND = ("{}", "Row 1 {}", "({})", "{}.", "AB{}CD", "{}%", "{}x", "{}e6", "{}²")


@query(_SPELT_SQL + """
, w AS (SELECT l_orderkey, l_linenumber, """ + _STYLE_SQL + """ AS style, k // 12 % 9 AS around, token FROM s),
p AS (SELECT l_orderkey, style FROM w WHERE around IN (0, 1, 2) OR (around = 3 AND style IS NOT NULL))
SELECT o.l_orderkey, coalesce(array_to_string(list_sort(list(DISTINCT style) FILTER (style IS NOT NULL)), ','), '') AS styles FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN p USING (l_orderkey) GROUP BY 1""")
def number_conventions(spark, sf_dir):
    """What whole texts prove: spellings in rows, brackets and sentences count, those inside
    identifiers, rates, counts, exponents and powers don't."""
    from factloom.operators.values import conventions

    around = F.floor((F.col("l_orderkey") + F.col("l_linenumber")) / 12) % 9
    said = F.lit(None).cast("string")
    for i, frame in enumerate(_AROUND):
        before, after = frame.split("{}")
        said = F.when(around == i, F.concat(F.lit(before), "token", F.lit(after))).otherwise(said)
    lines = _spelt(spark, sf_dir).select("l_orderkey", F.struct("l_linenumber", said.alias("said")).alias("x"))
    texts = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), " ; ").alias("text"))
    return conventions(texts).select("l_orderkey", F.array_join("number_styles", ",").alias("styles"))


_SIGNED = (("{}", 1), ("({})", -1), ("{}-", -1), ("$ {}", 1), ("-$ {}", -1), ("{}%", 0), ("--{}", 0), ("1 {}", 0), ("Subtotal {} - 15% DISC", 1), ("{} / 2", 0), ("{}x7", 0))


@query(_TOKENS_SQL + """
SELECT l_orderkey, l_linenumber, CAST(sum(CASE k WHEN 0 THEN price WHEN 1 THEN -price WHEN 2 THEN -price WHEN 3 THEN price WHEN 4 THEN -price WHEN 8 THEN price ELSE 0 END) AS DOUBLE) AS total, count(*) FILTER (k IN (0, 1, 2, 3, 4, 8)) AS n
FROM (SELECT *, l_partkey % 11 AS k FROM parts) GROUP BY l_orderkey, l_linenumber, l_partkey""")
def numbers_in_text(spark, sf_dir):
    """Signs, brackets, currencies and rates around amounts, as the scanner takes them."""
    from factloom.operators.values import all_numbers

    rows = _tokens(spark, sf_dir).where("spelling = 0")
    said = F.lit(None).cast("string")
    for i, (frame, _) in enumerate(_SIGNED):
        before, after = frame.split("{}")
        said = F.when(F.col("l_partkey") % len(_SIGNED) == i, F.concat(F.lit(before), "token", F.lit(after))).otherwise(said)
    found = all_numbers(rows.select("l_orderkey", "l_linenumber", "l_partkey", said.alias("text"))).withColumn("t", F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x))
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.sum("t").alias("total"), F.sum(F.size("numbers")).alias("n")).drop("l_partkey")


_DATE_FORMS = ("%Y-%m-%d", "%m/%d/%Y", "%m/%d/%y", "%d/%m/%Y", "%d/%m/%y", "%m-%d-%Y", "%d-%m-%Y", "%m-%d-%y", "%d-%m-%y", "%m.%d.%Y", "%d.%m.%Y", "%m.%d.%y", "%d.%m.%y", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y/%m/%d")
_SPARK_FORMS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%B": "MMMM", "%b": "MMM"}


def _by_key(pieces: list[str]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(pieces)) + " END"


@query("WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 18 AS k FROM orders), t AS (SELECT *, " + _by_key([f"strftime(day, '{f}')" for f in _DATE_FORMS]) + " AS said FROM d) SELECT o_orderkey, said, CAST(CAST(coalesce(" + ", ".join(f"CASE WHEN regexp_matches(said, '[0-9]{{4}}') = {'%Y' in f} THEN try_strptime(said, '{f}') END" for f in _DATE_FORMS) + ") AS DATE) AS VARCHAR) AS day FROM t WHERE k NOT IN (2, 4, 7, 8, 11, 12) OR year(day) > 1999")
def dates_parsed(spark, sf_dir):
    """Every order's date in one of eighteen formats, alone or within a sentence, parsed from it."""
    from factloom.operators.values import parsed_dates

    day, k = F.to_date("o_orderdate"), F.col("o_orderkey") % len(_DATE_FORMS)
    said = F.lit(None).cast("string")
    for i, form in enumerate(_DATE_FORMS):
        for c, spark_form in _SPARK_FORMS.items():
            form = form.replace(c, spark_form)
        said = F.when(k == i, F.date_format(day, form)).otherwise(said)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"), F.col("o_orderkey").alias("_k"), day.alias("_on"))
    rows = rows.where(~(k.isin(2, 4, 7, 8, 11, 12)) | (F.year("_on") > 1999))
    found = parsed_dates(rows.select("o_orderkey", "said", F.when((F.col("_k") % 5 == 0) | F.contains("said", F.lit("/")), F.col("said")).otherwise(F.concat(F.lit("Issued: "), "said", F.lit(" (copy)"))).alias("text")))
    return found.select("o_orderkey", "said", F.col("day").cast("string").alias("day"))


_DATES_SQL = """
WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 4 AS form FROM orders),
t AS (SELECT *, CASE form WHEN 0 THEN strftime(day, '%d/%m/%Y') WHEN 1 THEN strftime(day, '%m/%d/%Y') WHEN 2 THEN strftime(day, '%d.%m.%y') ELSE strftime(day, '%m-%d-%y') END AS said FROM d),
r AS (SELECT *, CASE form WHEN 0 THEN try_strptime(said, '%m/%d/%Y') WHEN 1 THEN try_strptime(said, '%m/%d/%Y') WHEN 2 THEN try_strptime(said, '%m.%d.%y') ELSE try_strptime(said, '%m-%d-%y') END::DATE AS mdy,
  CASE form WHEN 0 THEN try_strptime(said, '%d/%m/%Y') WHEN 1 THEN try_strptime(said, '%d/%m/%Y') WHEN 2 THEN try_strptime(said, '%d.%m.%y') ELSE try_strptime(said, '%d-%m-%y') END::DATE AS dmy FROM t),
o AS (SELECT *, CASE WHEN mdy IS NOT NULL AND dmy IS NULL THEN 'mdy' WHEN dmy IS NOT NULL AND mdy IS NULL THEN 'dmy' END AS proved FROM r)
"""


def _dates(spark, sf_dir) -> DataFrame:
    day, form = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(form == 0, F.date_format(day, "dd/MM/yyyy")).when(form == 1, F.date_format(day, "MM/dd/yyyy")).when(form == 2, F.date_format(day, "dd.MM.yy")).otherwise(F.date_format(day, "MM-dd-yy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", day.alias("day"), said.alias("said"))
    r = C.numeric_date(F.col("said"))
    return rows.withColumn("r", r).select("*", F.col("r.mdy").alias("mdy"), F.col("r.dmy").alias("dmy"), C.date_order(F.col("r")).alias("proved"))


@query(_DATES_SQL + "SELECT o_orderkey, said, CAST(mdy AS VARCHAR) AS mdy, CAST(dmy AS VARCHAR) AS dmy, proved FROM o")
def date_readings(spark, sf_dir):
    return _dates(spark, sf_dir).select("o_orderkey", "said", F.col("mdy").cast("string").alias("mdy"), F.col("dmy").cast("string").alias("dmy"), "proved")


@query(_DATES_SQL + "SELECT o_custkey, count(DISTINCT proved) AS n_orders, CASE WHEN count(DISTINCT proved) = 1 THEN min(proved) END AS date_order FROM o GROUP BY 1")
def date_order_by_cust(spark, sf_dir):
    found = _dates(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_set("proved")).alias("s"))
    return found.select("o_custkey", F.size("s").cast("long").alias("n_orders"), C.settled(F.col("s")).alias("date_order"))


@query(_DATES_SQL + """, c AS (SELECT o_custkey, CASE WHEN count(DISTINCT proved) = 1 THEN min(proved) END AS date_order FROM o GROUP BY 1),
q AS (SELECT o.*, date_order, CAST(day + CAST(s AS INTEGER) AS DATE) AS claim, s FROM o JOIN c USING (o_custkey), (SELECT unnest([0, 1]) AS s))
SELECT s AS shift, CASE WHEN mdy IS NULL AND dmy IS NULL THEN 'unreadable'
  WHEN mdy IS NOT NULL AND dmy IS NOT NULL AND mdy <> dmy AND date_order IS NOT NULL THEN CASE WHEN claim = CASE date_order WHEN 'mdy' THEN mdy ELSE dmy END THEN 'supported' ELSE 'unsupported' END
  WHEN mdy IS NOT NULL AND dmy IS NOT NULL AND mdy <> dmy AND (claim = mdy OR claim = dmy) THEN 'unsettled'
  WHEN mdy IS NOT NULL AND dmy IS NOT NULL AND mdy <> dmy THEN 'unsupported'
  WHEN claim = coalesce(mdy, dmy) THEN 'supported' ELSE 'unsupported' END AS verdict, count(*) AS n FROM q GROUP BY 1, 2""")
def date_check(spark, sf_dir):
    rows = _dates(spark, sf_dir)
    orders = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_set("proved")).alias("s")).select("o_custkey", C.settled(F.col("s")).alias("date_order"))
    rows = rows.join(orders, "o_custkey").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1))))
    claim = F.date_add("day", F.col("shift")).cast("string")
    return rows.select("shift", C.check_date(claim, F.col("r"), F.col("date_order")).alias("verdict")).groupBy("shift", "verdict").agg(F.count("*").alias("n"))


@query(r"""
WITH t AS (SELECT o_orderkey % 6 AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders),
x AS (SELECT k, CASE k WHEN 0 THEN iso WHEN 1 THEN iso || chr(10) WHEN 2 THEN iso[1:5] || '13' || iso[8:] WHEN 3 THEN replace(iso, '-', '/') WHEN 4 THEN ' ' || iso ELSE iso[1:8] || '30' END AS said FROM t)
SELECT k AS form, count(*) AS n, count(*) FILTER (regexp_full_match(said, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(said AS DATE) IS NOT NULL) AS n_valid FROM x GROUP BY 1""")
def iso_date_strict(spark, sf_dir):
    iso, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    text = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("\n"))).when(k == 2, F.concat(F.substring(iso, 1, 5), F.lit("13"), F.substring(iso, 8, 3))).when(k == 3, F.replace(iso, F.lit("-"), F.lit("/"))).when(k == 4, F.concat(F.lit(" "), iso)).otherwise(F.concat(F.substring(iso, 1, 8), F.lit("30")))
    return table(spark, sf_dir, "orders").select(k.alias("form"), C.iso_date(text).alias("d")).groupBy("form").agg(F.count("*").alias("n"), F.count("d").alias("n_valid"))


@query("""
SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'N' THEN 'unclear' WHEN (l_linestatus = 'F') = (l_returnflag = 'R') THEN 'supported' ELSE 'unsupported' END AS verdict, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3""")
def bool_check(spark, sf_dir):
    said = F.when(F.col("l_returnflag") == "R", "Returned by customer: Yes.").when(F.col("l_returnflag") == "A", "accepted = FALSE").otherwise("no changes: approval confirmed, yes")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", C.check_bool(F.col("l_linestatus") == "F", said).alias("verdict"))
    return rows.groupBy("l_returnflag", "l_linestatus", "verdict").agg(F.count("*").alias("n"))


@query(r"""
SELECT c_custkey, len(list_filter(regexp_extract_all(c_name || ' 7', '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all('Customer ' || c_name, '[0-9]+'), x))) = 0 AS with_seven,
  TRUE AS as_named, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') AS letters FROM customer""")
def string_check(spark, sf_dir):
    name = F.col("c_name")
    evidence = F.concat(F.lit("Customer "), name)
    return table(spark, sf_dir, "customer").select("c_custkey", C.digits_present(F.concat(name, F.lit(" 7")), evidence).alias("with_seven"), C.digits_present(name, evidence).alias("as_named"), C.bare_text(name).alias("letters"))


@query(r"""
SELECT p_partkey, CAST(levenshtein(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(p_type), '[^a-z0-9]+', '', 'g')) AS INTEGER) AS distance FROM part""")
def letter_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(C.bare_text(F.col("p_name")), C.bare_text(F.col("p_type"))).alias("distance"))


# ---------------------------------------------------------------- layout

_BOX_SQL = """
WITH b AS (SELECT l_orderkey, CAST(l_orderkey % 3 AS INTEGER) AS page, l_linenumber * 14.0::DOUBLE AS top, l_linenumber * 14.0::DOUBLE + CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 10 END AS bottom, (l_partkey % 500)::DOUBLE AS x0, (l_partkey % 500)::DOUBLE + 20 AS x1, l_partkey, l_suppkey, l_quantity FROM lineitem)
"""


def _boxes(spark, sf_dir) -> DataFrame:
    top, x0 = F.col("l_linenumber") * F.lit(14.0), (F.col("l_partkey") % 500).cast("double")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 3).cast("int").alias("page"), top.alias("top"), (top + F.when(F.col("l_partkey") % 50 == 0, 0).otherwise(10)).alias("bottom"), x0.alias("x0"), (x0 + 20).alias("x1"), "l_partkey", "l_suppkey", "l_quantity")


@query(_BOX_SQL + """, a AS (SELECT l_orderkey, page, min(top) + 4 AS atop, min(top) + 14 AS abottom FROM b GROUP BY 1, 2),
n AS (SELECT b.*, count(*) OVER (PARTITION BY l_orderkey) AS n FROM b JOIN a USING (l_orderkey, page) WHERE bottom > top AND least(bottom, abottom) - greatest(top, atop) > 0 AND least(bottom, abottom) - greatest(top, atop) >= least(bottom - top, abottom - atop) / 2)
SELECT l_orderkey, l_partkey, l_suppkey, top FROM n WHERE n = 1""")
def row_resolution(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    anchors = b.groupBy("l_orderkey", "page").agg(F.min("top").alias("t")).select("l_orderkey", "page", (F.col("t") + 4).alias("top"), (F.col("t") + 14).alias("bottom"))
    return R.same_row(b, anchors, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "top")


@query(_BOX_SQL + """, m AS (SELECT l_orderkey, top, min(x0) AS x0, max(x1) AS x1, max(bottom) AS bottom FROM b GROUP BY 1, 2)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY top) - 1 AS line_no, x0, top, x1, bottom FROM m""")
def rects_by_line(spark, sf_dir):
    return R.merged_boxes(_boxes(spark, sf_dir), "l_orderkey")


@query(_BOX_SQL + """, h AS (SELECT l_orderkey, top + 10 AS at, 'H' || CAST(l_partkey AS VARCHAR) AS header FROM b WHERE l_partkey % 5 = 0),
i AS (SELECT l_orderkey, l_partkey * 100000 + l_suppkey AS item, top FROM b WHERE l_partkey % 5 <> 0)
SELECT i.l_orderkey, i.item, i.top, (SELECT max_by(h.header, h.at * 1e9 + CAST(substr(h.header, 2) AS DOUBLE)) FROM h WHERE h.l_orderkey = i.l_orderkey AND h.at <= i.top) AS header FROM i""")
def header_above(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    headers = b.where("l_partkey % 5 = 0").groupBy("l_orderkey", (F.col("top") + 10).alias("bottom")).agg(F.concat(F.lit("H"), F.max("l_partkey").cast("string")).alias("header"))
    items = b.where("l_partkey % 5 <> 0").select("l_orderkey", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("item"), "top")
    return R.header_above(items, headers, "l_orderkey")


_LINES_SQL = """
WITH l AS (SELECT user_id, event_id, event_type = 'error' AS is_header, value < 40 AS is_table FROM events),
h AS (SELECT *, sum(is_header::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS hn FROM l),
k AS (SELECT *, sum((NOT is_table AND NOT is_header)::INT) OVER (PARTITION BY user_id, hn ORDER BY event_id) AS broken FROM h WHERE hn > 0)
"""


@query(_LINES_SQL + "SELECT user_id, min(event_id) AS header_line, max(event_id) AS last_line FROM k WHERE broken = 0 GROUP BY user_id, hn")
def table_extent(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), (F.col("event_type") == "error").alias("is_header"), (F.col("value") < 40).alias("is_table"))
    return R.table_extent(lines, "user_id")


@query(_BOX_SQL + """, v AS (SELECT DISTINCT l_orderkey, l_partkey AS token, x0, x1 FROM b),
h AS (SELECT DISTINCT l_orderkey, 'C' || CAST(l_suppkey % 7 AS VARCHAR) AS name, (l_suppkey % 7) * 70.0 AS hx0, (l_suppkey % 7) * 70.0 + 30 AS hx1 FROM b)
SELECT v.l_orderkey, v.token, CASE WHEN count(name) = 1 THEN min(name) END AS column_name FROM v LEFT JOIN h ON v.l_orderkey = h.l_orderkey AND least(x1, hx1) - greatest(x0, hx0) > 0 AND least(x1, hx1) - greatest(x0, hx0) >= least(x1 - x0, hx1 - hx0) / 2 GROUP BY 1, 2""")
def column_of_value(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    values = b.select("l_orderkey", F.col("l_partkey").alias("token"), "x0", "x1").distinct()
    left = (F.col("l_suppkey") % 7) * F.lit(70.0)
    headers = b.select("l_orderkey", F.concat(F.lit("C"), (F.col("l_suppkey") % 7).cast("string")).alias("name"), left.alias("x0"), (left + 30).alias("x1")).distinct()
    return R.unique_column(values, headers, "l_orderkey")


@query("""
WITH p AS (SELECT p_brand AS label, p_partkey AS point_id, (p_partkey % 997) * 1.0 AS x, (p_partkey % 499) * 1.0 AS y FROM part),
b AS (SELECT p_brand AS label, p_partkey AS box_id, (p_partkey % 997) * 1.0 AS x0, (p_partkey % 499) * 1.0 AS y0, (p_partkey % 997) + p_size * 1.0 AS x1, (p_partkey % 499) + p_size * 1.0 AS y1 FROM part)
SELECT point_id, min(box_id) AS box_id FROM p JOIN b ON p.label = b.label AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1 HAVING count(*) = 1""")
def glyph_association(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    x, y = (F.col("p_partkey") % 997).cast("double"), (F.col("p_partkey") % 499).cast("double")
    points = part.select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("point_id"), x.alias("x"), y.alias("y"))
    boxes = part.select(F.col("p_brand").alias("label"), F.col("p_partkey").alias("box_id"), x.alias("x0"), y.alias("y0"), (x + F.col("p_size")).alias("x1"), (y + F.col("p_size")).alias("y1"))
    return R.grid_association(points, boxes)


# ---------------------------------------------------------------- arithmetic


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(p_retailprice AS DECIMAL(12,2)) AS u, CAST(l_extendedprice AS DECIMAL(18,2)) AS e FROM lineitem JOIN part ON l_partkey = p_partkey),
c AS (SELECT k, CASE k WHEN 0 THEN e WHEN 1 THEN q * u WHEN 2 THEN q * u + 0.02 WHEN 3 THEN q * u + 0.03 END AS observed, q * u AS computed FROM l, (SELECT unnest([0, 1, 2, 3, 4]) AS k))
SELECT k AS claim, CASE WHEN observed IS NULL THEN 'not_checked' WHEN abs(observed - computed) <= 0.02 THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM c GROUP BY 1, 2""")
def line_extension(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    computed = F.col("l_quantity").cast("decimal(12,2)") * F.col("p_retailprice").cast("decimal(12,2)")
    dec = lambda x: F.lit(x).cast("decimal(10,4)")
    claims = F.array(F.struct(F.lit(0).alias("claim"), _money("l_extendedprice").cast("decimal(30,4)").alias("observed")), *(F.struct(F.lit(k).alias("claim"), (computed + dec(s)).cast("decimal(30,4)").alias("observed")) for k, s in ((1, "0"), (2, "0.02"), (3, "0.03"))), F.struct(F.lit(4).alias("claim"), F.lit(None).cast("decimal(30,4)").alias("observed")))
    rows = rows.select(computed.alias("computed"), F.explode(claims).alias("c"))
    return rows.select("c.claim", C.three_valued(F.col("c.observed"), F.col("computed")).alias("status")).groupBy("claim", "status").agg(F.count("*").alias("n"))


_SUBTOTAL_SQL = """
WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS computed FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, computed, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) WHEN 1 THEN computed ELSE computed + 0.03 END AS observed FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
r AS (SELECT o_orderkey, computed, observed, CASE WHEN observed IS NULL OR computed IS NULL THEN 'not_checked' WHEN abs(observed - computed) <= 0.02 THEN 'passed' ELSE 'failed' END AS status FROM o)
"""


def _subtotals(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _money("l_extendedprice").alias("amount"))
    s = lines.groupBy("o_orderkey").agg(F.sum("amount").alias("t"))
    k = F.col("o_orderkey") % 3
    orders = table(spark, sf_dir, "orders").join(s, "o_orderkey", "left").select("o_orderkey", F.when(k == 0, _money("o_totalprice")).when(k == 1, F.col("t")).otherwise(F.col("t") + F.lit("0.03").cast("decimal(10,2)")).alias("observed"))
    return R.lines_sum(lines, "o_orderkey", "amount", orders, "observed")


@query(_SUBTOTAL_SQL + "SELECT o_orderkey, CAST(computed AS DOUBLE) AS computed, CAST(observed AS DOUBLE) AS observed, status FROM r")
def items_subtotal(spark, sf_dir):
    return _subtotals(spark, sf_dir).select("o_orderkey", F.col("computed").cast("double").alias("computed"), F.col("observed").cast("double").alias("observed"), "status")


@query("""
WITH t AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_totalprice * 0.08 AS DECIMAL(18,2)) AS tax FROM orders),
u AS (SELECT *, total - tax + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.02 ELSE 0.05 END AS subtotal FROM t)
SELECT o_orderkey % 3 AS k, CASE WHEN abs(total - (subtotal + tax)) <= 0.02 THEN 'passed' ELSE 'failed' END AS status, count(*) AS n FROM u GROUP BY 1, 2""")
def subtotal_tax_total(spark, sf_dir):
    total, k = _money("o_totalprice"), F.col("o_orderkey") % 3
    tax = (F.col("o_totalprice") * 0.08).cast("decimal(18,2)")
    shift = F.when(k == 0, F.lit("0.00")).when(k == 1, F.lit("0.02")).otherwise(F.lit("0.05")).cast("decimal(10,2)")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), total.alias("total"), tax.alias("tax"), (total - tax + shift).alias("subtotal"))
    return rows.select("k", C.three_valued(F.col("total"), F.col("subtotal") + F.col("tax")).alias("status")).groupBy("k", "status").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN l_shipdate < o_orderdate THEN 'failed' ELSE 'passed' END AS status, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def due_date_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    due, issue = (C.iso_date(F.date_format(c, "yyyy-MM-dd")) for c in ("l_shipdate", "o_orderdate"))
    status = F.when(due.isNull() | issue.isNull(), "not_checked").when(due >= issue, "passed").otherwise("failed")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- reports, review, export


def _fields(spark, sf_dir) -> DataFrame:
    """A report of two fields an order: its total and its status letter."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    status = F.when(k == 0, "unsupported").when(k == 1, "needs_review").otherwise("verified")
    item = lambda path, value, s: F.struct(F.lit(path).alias("path"), value.alias("value"), s.alias("status"))
    flat = orders.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(item("total", C.plain_number(_money("o_totalprice")), status), item("status", F.col("o_orderstatus"), F.lit("verified")))).alias("f"))
    return flat.select("doc_id", "f.*", F.array().cast("array<string>").alias("reasons"))


_FIELDS_SQL = """
f AS (SELECT o_orderkey AS doc_id, 'total' AS path, regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') AS value, CASE o_orderkey % 5 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'needs_review' ELSE 'verified' END AS status FROM orders
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, 'verified' FROM orders)
""".replace("\\\\", "\\")


@query(_SUBTOTAL_SQL + ", " + _FIELDS_SQL + """, i AS (SELECT o_orderkey AS doc_id FROM r WHERE status = 'failed')
SELECT f.doc_id, path, CASE WHEN i.doc_id IS NOT NULL AND path = 'total' AND status = 'verified' THEN 'needs_review' ELSE status END AS status, CAST(CASE WHEN i.doc_id IS NOT NULL AND path = 'total' THEN 1 ELSE 0 END AS INTEGER) AS n_reasons FROM f LEFT JOIN i USING (doc_id)""")
def cross_issue_downgrade(spark, sf_dir):
    issues = _subtotals(spark, sf_dir).where("status = 'failed'").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("issue_no"), F.lit("the lines' sum does not add up to the total").alias("message"), F.array(F.lit("total"), F.lit("nowhere")).alias("paths"))
    return R.downgrade(_fields(spark, sf_dir), issues).select("doc_id", "path", "status", F.size("reasons").alias("n_reasons"))


_ACTIONS_SQL = """
a AS (SELECT event_id % 400 AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'total' ELSE 'status' END AS path, event_id AS seq,
  CASE event_id // 3 % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'edit' WHEN 2 THEN 'reject' ELSE 'reset' END AS action, 'v' || CAST(event_id % 97 AS VARCHAR) AS value FROM events),
z AS (SELECT *, coalesce(max(CASE WHEN action = 'reset' THEN seq END) OVER (PARTITION BY doc_id, path), -1) AS rs FROM a),
v AS (SELECT doc_id, path, CASE max_by(action, seq) WHEN 'approve' THEN 'approved' WHEN 'edit' THEN 'edited' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS review_status,
  max_by(value, seq) FILTER (action = 'edit' AND seq > rs) AS edited_value FROM z GROUP BY 1, 2)
"""


def _review(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    k = F.floor(e / 3) % 4
    actions = table(spark, sf_dir, "events").select((e % 400).alias("doc_id"), F.when(e % 2 == 0, "total").otherwise("status").alias("path"), e.alias("seq"), F.when(k == 0, "approve").when(k == 1, "edit").when(k == 2, "reject").otherwise("reset").alias("action"), F.concat(F.lit("v"), (e % 97).cast("string")).alias("value"))
    return R.review_state(actions)


@query("WITH " + _ACTIONS_SQL + "SELECT * FROM v")
def review_state(spark, sf_dir):
    return _review(spark, sf_dir)


_EXPORT_SQL = "WITH " + _ACTIONS_SQL + ", " + _FIELDS_SQL + """
SELECT f.doc_id, f.path, coalesce(edited_value, value) AS value, value AS original_value, CASE WHEN edited_value IS NULL THEN 'extraction' ELSE 'correction' END AS value_source,
  status AS verification_status, coalesce(review_status, 'pending') AS review_status FROM f LEFT JOIN v USING (doc_id, path) WHERE coalesce(review_status, 'pending') """


@query(_EXPORT_SQL + "<> 'rejected'")
def export_all(spark, sf_dir):
    return R.export_rows(_fields(spark, sf_dir), _review(spark, sf_dir), "all")


@query(_EXPORT_SQL + "IN ('approved', 'edited')")
def export_reviewed(spark, sf_dir):
    return R.export_rows(_fields(spark, sf_dir), _review(spark, sf_dir), "reviewed")


@query("WITH " + _FIELDS_SQL + """SELECT doc_id, path, value, status FROM f WHERE contains(lower(value), '37') OR contains(lower(path), '37')
ORDER BY CASE status WHEN 'unsupported' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, doc_id, path LIMIT 50""")
def ui_sorted_fields(spark, sf_dir):
    rows = _fields(spark, sf_dir).where(F.contains(F.lower("value"), F.lit("37")) | F.contains(F.lower("path"), F.lit("37")))
    order = F.when(F.col("status") == "unsupported", 0).when(F.col("status") == "needs_review", 1).otherwise(2)
    return rows.orderBy(order, "doc_id", "path").limit(50).select("doc_id", "path", "value", "status")


@query("""SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def claims_flatten(spark, sf_dir):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(parsed).alias("path", "value")).where("value is not null")


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def member_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""
WITH r AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents)
SELECT source, count(*) AS n_pages, CAST(max(running) AS BIGINT) AS n_chars FROM r WHERE running <= 60000 GROUP BY 1""")
def page_budgets(spark, sf_dir):
    rows = R.within_budget(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 60000)
    return rows.groupBy("source").agg(F.count("*").alias("n_pages"), F.max("running").alias("n_chars"))


@query("""
WITH n AS (SELECT o_orderkey, o_orderkey % 5 AS k FROM orders)
SELECT k AS form, CASE k WHEN 0 THEN 'n' WHEN 1 THEN 'n' WHEN 2 THEN 'inlineStr' WHEN 3 THEN 'inlineStr' ELSE 'n' END AS cell, count(*) AS n FROM n GROUP BY 1, 2""")
def xlsx_cell_types(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, F.lit("12345")).when(k == 1, F.lit("999999999999999")).when(k == 2, F.lit("1000000000000000")).when(k == 3, F.lit("1234567890.1234567")).otherwise(F.lit("0.1")).cast("decimal(38,10)")
    return table(spark, sf_dir, "orders").groupBy(k.alias("form"), C.cell_type(value).alias("cell")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- evaluation

_OUTCOME_SQL = """
WITH o AS (SELECT l_orderkey AS doc, l_returnflag AS kind, l_linestatus AS variant, l_linenumber % 2 = 0 AS present, CASE WHEN l_quantity < 10 THEN 'unsupported' WHEN l_quantity < 25 THEN 'needs_review' ELSE 'verified' END AS status, l_discount > 0.05 AS place_ok FROM lineitem)
"""


def _outcomes(spark, sf_dir) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("variant"), (F.col("l_linenumber") % 2 == 0).alias("present"), F.when(q < 10, "unsupported").when(q < 25, "needs_review").otherwise("verified").alias("status"), (F.col("l_discount") > 0.05).alias("place_ok"))


_COUNTERS = "count(*) AS n, count(*) FILTER (status = 'verified') AS accepted, count(*) FILTER (status = 'verified' AND place_ok) AS accepted_right_place, count(DISTINCT doc) AS docs"


def _counters():
    ok = F.col("status") == "verified"
    return [F.count("*").alias("n"), F.count_if(ok).alias("accepted"), F.count_if(ok & F.col("place_ok")).alias("accepted_right_place"), F.countDistinct("doc").alias("docs")]


@query(_OUTCOME_SQL + f"SELECT kind, variant, present, {_COUNTERS} FROM o GROUP BY 1, 2, 3")
def outcome_aggregate(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("kind", "variant", "present").agg(*_counters())


@query(_OUTCOME_SQL + f"SELECT coalesce(kind, '*') AS kind, coalesce(variant, '*') AS variant, {_COUNTERS} FROM o GROUP BY CUBE (kind, variant)")
def outcome_slices(spark, sf_dir):
    rows = _outcomes(spark, sf_dir).cube("kind", "variant").agg(*_counters())
    return rows.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("kind", "variant")})


@query("""
WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN 'quote occurs 3 times' WHEN 1 THEN 'quote not found' WHEN 2 THEN '60.000 reads as 60 or 60000' WHEN 3 THEN 'the sum does not add up' ELSE 'something else' END AS reason FROM events)
SELECT CASE WHEN reason LIKE '%not found%' THEN 'not located' WHEN reason LIKE '%occurs%' THEN 'ambiguous' WHEN reason LIKE '%reads as%' THEN 'undecided number' WHEN reason LIKE '%does not add up%' THEN 'arithmetic' ELSE 'other' END AS reason_class, count(*) AS n FROM r GROUP BY 1""")
def reason_classes(spark, sf_dir):
    k = F.col("event_id") % 5
    reason = F.when(k == 0, "quote occurs 3 times").when(k == 1, "quote not found").when(k == 2, "60.000 reads as 60 or 60000").when(k == 3, "the sum does not add up").otherwise("something else")
    return table(spark, sf_dir, "events").groupBy(C.reason_class(reason).alias("reason_class")).agg(F.count("*").alias("n"))


@query(_OUTCOME_SQL + """, d AS (SELECT kind, doc, count(*) AS n, count(*) FILTER (status = 'verified') AS k FROM o GROUP BY 1, 2)
SELECT kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, CAST(sum(k) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate, count(*) AS docs, count(*) FILTER (k < 5) AS few FROM d GROUP BY 1""")
def receipt_intervals(spark, sf_dir):
    """The counts that intervals start from; ``receipt_cell_intervals`` gives the intervals."""
    d = _outcomes(spark, sf_dir).groupBy("kind", "doc").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "verified").alias("k"))
    return d.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), (F.sum("k").cast("double") / F.sum("n").cast("double")).alias("rate"), F.count("*").alias("docs"), F.count_if(F.col("k") < 5).alias("few"))


@query()
def receipt_cell_intervals(spark, sf_dir):
    """Accepted shares by kind with 95 % intervals; its bootstrap is random, so it has no SQL."""
    return R.cell_intervals(_outcomes(spark, sf_dir), ["kind"], "doc", F.col("status") == "verified")


@query("""
WITH d AS (SELECT l_partkey AS part, l_returnflag AS kind, l_orderkey AS doc, count(*) AS n, count(*) FILTER (l_quantity >= 25) AS k FROM lineitem GROUP BY 1, 2, 3),
c AS (SELECT part, kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, count(*) AS docs FROM d GROUP BY 1, 2)
SELECT part, kind, n, k, docs, CAST(k AS DOUBLE) / CAST(n AS DOUBLE) AS rate, least(1.0, CASE k WHEN 0 THEN 3.0 WHEN 1 THEN 4.74 WHEN 2 THEN 6.30 WHEN 3 THEN 7.75 ELSE 9.15 END::DOUBLE / docs) AS upper_95
FROM c WHERE k < 5""")
def receipt_cell_limits(spark, sf_dir):
    """The Poisson branch: cells of parts and kinds with fewer than five accepts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("doc"), (F.col("l_quantity") >= 25).alias("ok"))
    return R.cell_intervals(rows, ["part", "kind"], "doc", F.col("ok")).where("k < 5").drop("lower_95")


@query("WITH " + _FIELDS_SQL + """, b AS (SELECT doc_id, path, status FROM f WHERE NOT (status = 'unsupported' AND value LIKE '1%')),
a AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN 'needs_review' ELSE status END AS status FROM f WHERE value NOT LIKE '9%')
SELECT coalesce(b.status, 'absent') AS was, coalesce(a.status, 'absent') AS now, count(*) AS n FROM b FULL OUTER JOIN a USING (doc_id, path) GROUP BY 1, 2""")
def paired_runs(spark, sf_dir):
    f = _fields(spark, sf_dir)
    after = f.where("value not like '9%'").withColumn("status", F.when(F.col("doc_id") % 7 == 0, "needs_review").otherwise(F.col("status")))
    return R.compare_runs(f.where("not (status = 'unsupported' and value like '1%')"), after, ["doc_id", "path"], "status")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
p AS (SELECT a.l_orderkey, a.l_partkey, a.price, b.l_partkey AS donor, b.price AS donor_price, row_number() OVER (PARTITION BY a.l_orderkey, a.l_partkey, a.price ORDER BY b.l_partkey, b.price) AS rn
  FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = b.l_returnflag AND a.price <> b.price AND a.l_partkey <> b.l_partkey)
SELECT l_orderkey, l_partkey, CAST(price AS DOUBLE) AS price, donor, CAST(donor_price AS DOUBLE) AS donor_price FROM p WHERE rn = 1""")
def swapped_donor(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", _money("l_extendedprice").alias("price")).distinct()
    b = a.select("l_orderkey", "l_returnflag", F.col("l_partkey").alias("donor"), F.col("price").alias("donor_price"))
    first = a.join(b, ["l_orderkey", "l_returnflag"]).where("price <> donor_price and l_partkey <> donor").groupBy("l_orderkey", "l_partkey", "price").agg(F.min(F.struct("donor", "donor_price")).alias("d"))
    return first.select("l_orderkey", "l_partkey", F.col("price").cast("double").alias("price"), "d.donor", F.col("d.donor_price").cast("double").alias("donor_price"))


_PUNCT = "‘’‚‛“”„‟«»‐‑‒–—−"
_PLAIN = "''''\"\"\"\"\"\"------"


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(translate(text, '""" + _PUNCT + "', '" + _PLAIN.replace("'", "''") + r"""'), '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS digest FROM documents""")
def normalize_text(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.translate("text", _PUNCT, _PLAIN), R.SPACE, " "))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)
SELECT doc_id, 'total' AS path, CASE WHEN doc_id % 2 = 0 THEN 'verified' ELSE 'needs_review' END AS status, CAST(CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS INTEGER) AS n_reasons FROM o
UNION ALL SELECT doc_id, 'issue_date', CASE WHEN d > 12 OR d = m THEN 'verified' ELSE 'needs_review' END, CASE WHEN d > 12 OR d = m THEN 0 ELSE 1 END FROM o
UNION ALL SELECT doc_id, 'po_number', 'unsupported', 1 FROM o""")
def verify_fields(spark, sf_dir):
    """Every order as a one-line document with three claims: a total, every other one a cent
    off, its date and a number that no order shows."""
    from factloom.operators.verify import verify

    price = _money("o_totalprice")
    said = F.concat(F.format_string("%,d", F.floor(price).cast("long")), F.lit("."), F.lpad(F.pmod((price * 100).cast("long"), F.lit(100)).cast("string"), 2, "0"))
    on = F.date_format("o_orderdate", "dd/MM/yyyy")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), said.alias("said"), on.alias("on"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), price.alias("price"))
    words = R.page_words(orders.select("doc_id", F.concat_ws(" ", F.lit("Total"), "said", F.lit("dated"), "on").alias("text")))
    words = words.select("doc_id", F.lit(1).alias("page"), "word_no", F.col("word").alias("text"), F.col("start").cast("double").alias("x0"), F.lit(0.0).alias("top"), F.col("stop").cast("double").alias("x1"), F.lit(10.0).alias("bottom"), F.lit(False).alias("review_paint"))
    claim = lambda n, path, value, quote: F.struct(F.lit(n).alias("field_no"), F.lit(path).alias("path"), value.alias("value"), F.array(quote).alias("evidence"))
    off = F.col("price") + F.when(F.col("doc_id") % 2 == 0, F.lit("0.00")).otherwise(F.lit("0.01")).cast("decimal(10,2)")
    claims = orders.select("doc_id", F.explode(F.array(claim(0, "total", off.cast("string"), F.col("said")), claim(1, "issue_date", F.to_json(F.struct("iso")).substr(8, 12), F.col("on")), claim(2, "po_number", F.lit('"QQ"'), F.lit("purchase number QQ")))).alias("c"))
    claims = claims.select("doc_id", "c.*", F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("declared_kind"))
    return verify(words, claims).select("doc_id", "path", "status", F.size("reasons").alias("n_reasons"))


@query("""
SELECT d.doc_id, b.item_id, 100.0::DOUBLE * (length(b.text) - 1) / length(b.text) AS score, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start
FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) >= 8""")
def fuzzy_best_window(spark, sf_dir):
    """Benchmark passages with their fourth letter misread, searched in the whole texts that hold
    them: the best window is where the passage stands, one letter off."""
    from factloom.functions.text import best_window

    @F.pandas_udf("struct<score:double,start:long,stop:long>")
    def window(quote, said):
        import pandas as pd

        return pd.DataFrame([best_window(q, s) for q, s in zip(quote, said, strict=True)], columns=["score", "start", "stop"])

    docs, passages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").where(F.length("text") >= 8)
    pairs = R.containing(docs, passages).join(docs.select("doc_id", "text"), "doc_id").join(passages.select("item_id", F.col("text").alias("quote")), "item_id")
    misread = F.concat(F.substring("quote", 1, 3), F.lit("\uffff"), F.substring(F.col("quote"), F.lit(5), F.length("quote")))
    return pairs.select("doc_id", "item_id", window(misread, F.col("text")).alias("w")).select("doc_id", "item_id", "w.score", "w.start")


# ---------------------------------------------------------------- paint, capacity, halves

_PAINT = {0: "unavailable", 1: "no_contribution", 2: "ambiguous_overlap", 3: None}


@query("""
WITH w AS (SELECT l_orderkey, CASE l_partkey % 23 WHEN 0 THEN 'unavailable' WHEN 1 THEN 'no_contribution'
  WHEN 2 THEN 'ambiguous_overlap' WHEN 3 THEN NULL ELSE 'contributes' END AS state FROM lineitem)
SELECT l_orderkey, CASE WHEN count(*) FILTER (state = 'unavailable') > 0 THEN 'unavailable'
  WHEN count(*) FILTER (state = 'no_contribution') > 0 THEN 'no_contribution'
  WHEN count(*) FILTER (state = 'ambiguous_overlap') > 0 THEN 'ambiguous_overlap'
  WHEN count(*) FILTER (state = 'contributes') = count(*) THEN 'contributes' END AS paint_state
FROM w GROUP BY 1""")
def paint_state(spark, sf_dir):
    part = F.col("l_partkey") % 23
    state = F.when(F.coalesce(~part.isin(*_PAINT), F.lit(True)), "contributes")
    for remainder, name in _PAINT.items():
        state = state.when(part == remainder, name)
    return R.combined_paint(table(spark, sf_dir, "lineitem").select("l_orderkey", state.alias("state")), "l_orderkey", "state")


@query(r"""
SELECT source, count(*) AS n_documents, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS n_bytes,
  CAST(coalesce(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))), 0) AS BIGINT) AS n_words,
  count(*) >= 200 OR coalesce(sum(octet_length(encode(text))), 0) >= 1000000
    OR coalesce(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''))), 0) >= 100000 AS is_full
FROM documents GROUP BY 1""")
def session_capacity(spark, sf_dir):
    return R.capacity(table(spark, sf_dir, "documents"), "source", 200, 1_000_000, 100_000)


@query("""
WITH h AS (SELECT l_suppkey, bool_or(l_orderkey % 2 = 0) AS a, bool_or(l_orderkey % 2 <> 0) AS b FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1)
SELECT count(*) FILTER (a) AS n_first, count(*) FILTER (b) AS n_second, count(*) FILTER (a AND b) AS n_both FROM h""")
def companies_in_both_halves(spark, sf_dir):
    return R.seen_in_other_half(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_orderkey") % 2 == 0)
