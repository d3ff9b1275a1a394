"""Verification operators that are plain relations: words, containment, layout, arithmetic,
reports, review, exports and run comparison. All of them are DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import columns as C
from factloom.functions.columns import three_valued

#: Parts that the rows of a very common key are dealt in.
SALTS = 32
SPACE = r"[ \t\n\r\f\x0B]+"


def page_words(docs: DataFrame) -> DataFrame:
    """doc_id, word_no (from 0), word, start and stop: the words of a text and their offsets in
    the text of words joined by single spaces. Null and blank texts have no words."""
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    flat = docs.select("doc_id", F.posexplode(words).alias("word_no", "word"))
    before = Window.partitionBy("doc_id").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    return flat.select("doc_id", F.col("word_no").cast("long").alias("word_no"), "word", start.cast("long").alias("start")).withColumn("stop", F.col("start") + F.length("word"))


def containing(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id): the passages that a text contains.

    Candidates come from an equi-join of a passage's longest interior word with the texts'
    distinct words; for passages of under three words, which have none, the first three
    characters of the first word stand for it. Blank passages alone are looked for in every
    text. Empty passages and null texts are in nothing.
    """
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = passages.select("item_id", F.col("text").alias("quote"), longest.alias("anchor"))
    seen = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("anchor"))
    pairs = seen.join(asked.where("anchor is not null").select("item_id", "anchor"), "anchor").select("doc_id", "item_id")
    found = pairs.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("item_id", "quote"), "item_id").where(F.contains("text", F.col("quote"))).select("doc_id", "item_id")
    short = asked.where("anchor is null and quote <> ''")
    if short.isEmpty():
        return found
    starts = F.transform(F.filter(F.split("quote", SPACE), lambda w: w != ""), lambda w: F.substring(w, 1, 3))
    short = short.select("item_id", "quote", F.coalesce(F.try_element_at(starts, F.lit(1)), F.lit("")).alias("gram"))
    cut = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr(w, i, n))))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), F.flatten(F.transform(F.array_distinct(words), cut))))
    # nearly every text has a blank and the commonest letters: such grams are dealt in parts
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    dealt = short.select("item_id", "gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = docs.select("doc_id", salt, F.explode(grams).alias("gram")).join(dealt, ["gram", "salt"]).select("doc_id", "item_id")
    rest = pairs.join(docs.select("doc_id", "text"), "doc_id").join(short.select("item_id", "quote"), "item_id").where(F.contains("text", F.col("quote")))
    return found.unionByName(rest.select("doc_id", "item_id"))


def location_verdicts(found: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, n_places and status: one place verified, several needs_review, none unsupported."""
    n = found.groupBy("item_id").agg(F.count("*").alias("n_places"))
    n = passages.select("item_id").join(n, "item_id", "left").select("item_id", F.coalesce("n_places", F.lit(0)).cast("long").alias("n_places"))
    return n.withColumn("status", F.when(F.col("n_places") == 0, "unsupported").when(F.col("n_places") == 1, "verified").otherwise("needs_review"))


def overlapping_occurrences(text: Column, quote: Column) -> Column:
    """Number of places where ``quote`` starts in ``text``, overlaps included."""
    return F.regexp_count(text, F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))).cast("long")


def occurrences_in_words(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(doc_id, item_id, n): how often quotes without white space stand in texts, overlaps
    included; pairs without a place have no row.

    Such a quote stands within one word. The distinct words of all texts are matched once, over
    their three-letter beginnings, and the texts' word counts are joined with what was found, so
    that no text travels. Null and empty quotes stand nowhere.
    """
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    held = docs.select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("_n"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substr("word", i, F.lit(3))))
    vocabulary = held.select("word").distinct().select("word", F.explode(grams).alias("gram"))
    asked = quotes.where("quote <> ''").select("item_id", "quote", F.substring("quote", 1, 3).alias("gram"))
    met = vocabulary.join(asked, "gram").where(F.contains("word", F.col("quote")))
    short = asked.where(F.length("quote") < 3).select("item_id", "quote")
    if not short.isEmpty():  # shorter than a gram: any gram may begin with it
        few = vocabulary.select("word", F.explode(F.array(F.substring("gram", 1, 1), F.substring("gram", 1, 2))).alias("quote")).distinct().join(short, "quote")
        met = met.select("word", "item_id", "quote").unionByName(few.select("word", "item_id", "quote")).distinct()
    met = met.select("word", "item_id", overlapping_occurrences(F.col("word"), F.col("quote")).alias("_k"))
    return held.join(met, "word").groupBy("doc_id", "item_id").agg(F.sum(F.col("_n") * F.col("_k")).alias("n"))


def within_budget(rows: DataFrame, key: str, order: str, amount: str, budget: int, width: int = 4096) -> DataFrame:
    """The rows of each ``key`` whose running sum of ``amount``, in the order of the whole number
    ``order``, is at most ``budget``, with that sum as ``running``.

    Sums of ranges of ``width`` numbers come first; ranges that begin beyond the budget are left
    out, and the others are sorted and summed each in a task of its own. Amounts must not be
    negative; null ones count as nothing, null orders come first.
    """
    rows = rows.withColumn("_range", F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**60))))
    sums = rows.groupBy(key, "_range").agg(F.sum(amount).alias("_s"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_range").alias("_at"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before")).where(F.col("_before") <= budget)
    kept = rows.join(sums, rows[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_at")))
    upto = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = kept.withColumn("running", F.col("_before") + F.coalesce(F.sum(amount).over(upto), F.lit(0)))
    return out.where(F.col("running") <= budget).drop("_range", "_key", "_at", "_before")


def report_counts(fields: DataFrame, *keys: str) -> DataFrame:
    """Counts of the three statuses, zeros included."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "needs_review", "unsupported")]
    return fields.groupBy(*keys).agg(*counts)


def same_row(candidates: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """The candidate on its anchor's row, where it is the only one.

    Both need ``key``, page, top and bottom. Rows overlap by at least half of the smaller
    height. Invalid geometry never matches.
    """
    ok = lambda t, b: ~F.isnan(t) & ~F.isnan(b) & (F.col(b) > F.col(t))
    anchor = anchors.where(ok("top", "bottom")).select(key, F.col("page").alias("_page"), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    both = candidates.where(ok("top", "bottom")).join(anchor, key).where("page = _page")
    overlap = F.least("bottom", "_bottom") - F.greatest("top", "_top")
    near = both.where((overlap > 0) & (overlap >= F.least(F.col("bottom") - F.col("top"), F.col("_bottom") - F.col("_top")) / 2))
    n = F.count("*").over(Window.partitionBy(key))
    return near.withColumn("_n", n).where("_n = 1").drop("_n", "_page", "_top", "_bottom")


def merged_boxes(words: DataFrame, key: str, gap: float = 3.0) -> DataFrame:
    """One box per line of a match's words: sorted by top and left, a line ends at a word more
    than ``gap`` below the line's first word. Ordered fold; a match's words are few."""
    box = F.struct("top", "x0", "x1", "bottom")
    sorted_ = F.array_sort(F.collect_list(box))
    start = F.array().cast("array<struct<first:double,top:double,x0:double,x1:double,bottom:double>>")

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        fresh = (F.size(lines) == 0) | (F.abs(w["top"] - last["first"]) > gap)
        one = F.struct(w["top"].alias("first"), w["top"].alias("top"), w["x0"].alias("x0"), w["x1"].alias("x1"), w["bottom"].alias("bottom"))
        grown = F.struct(last["first"].alias("first"), F.least(last["top"], w["top"]).alias("top"), F.least(last["x0"], w["x0"]).alias("x0"), F.greatest(last["x1"], w["x1"]).alias("x1"), F.greatest(last["bottom"], w["bottom"]).alias("bottom"))
        return F.when(fresh, F.concat(lines, F.array(one))).otherwise(F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(grown)))

    lines = words.groupBy(key).agg(sorted_.alias("_w")).select(key, F.posexplode(F.aggregate("_w", start, step)).alias("line_no", "b"))
    return lines.select(key, F.col("line_no").cast("long").alias("line_no"), "b.x0", "b.top", "b.x1", "b.bottom")


def header_above(items: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """Each item with the last header that ends at or above its top: an as-of join on ``key``."""
    both = items.select(key, "item", "top", F.lit(None).cast("string").alias("header"), F.lit(1).alias("kind"), F.col("top").alias("at")).unionByName(
        headers.select(key, F.lit(None).cast("long").alias("item"), F.lit(None).cast("double").alias("top"), "header", F.lit(0).alias("kind"), F.col("bottom").alias("at"))
    )
    upward = Window.partitionBy(key).orderBy("at", "kind", "header").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("header", F.last("header", True).over(upward)).where("kind = 1").select(key, "item", "top", "header")


def table_extent(lines: DataFrame, key: str) -> DataFrame:
    """For each header line, the last line of the unbroken run of table lines below it.

    ``lines``: key, line_no, is_header, is_table. Gaps and islands by running counts.
    """
    down = Window.partitionBy(key).orderBy("line_no")
    marked = lines.withColumn("_h", F.sum(F.col("is_header").cast("int")).over(down)).where("_h > 0")
    within = Window.partitionBy(key, "_h").orderBy("line_no")
    broken = F.sum((~F.col("is_table") & ~F.col("is_header")).cast("int")).over(within)
    kept = marked.withColumn("_broken", broken).where("_broken = 0")
    return kept.groupBy(key, "_h").agg(F.min("line_no").alias("header_line"), F.max("line_no").alias("last_line")).drop("_h")


def unique_column(values: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """The one header that covers at least half of the narrower width of a value, else null."""
    h = headers.select(F.col(key).alias("_key"), "name", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"))
    overlap = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    hit = (F.col(key) == F.col("_key")) & (overlap > 0) & (overlap >= F.least(F.col("x1") - F.col("x0"), F.col("_x1") - F.col("_x0")) / 2)
    both = values.join(h, hit, "left")
    return both.groupBy(key, "token").agg(F.when(F.count("name") == 1, F.min("name")).alias("column_name"))


def grid_association(points: DataFrame, boxes: DataFrame, cell: float = 64.0) -> DataFrame:
    """Each point with the only box of its label that contains it: an equi-join on label and
    grid cell, then containment."""
    at = lambda c: F.floor(F.col(c) / cell)
    dealt = boxes.select("label", "box_id", "x0", "y0", "x1", "y1", F.explode(F.sequence(at("x0"), at("x1"))).alias("cx"), "*").select("label", "box_id", "x0", "y0", "x1", "y1", "cx", F.explode(F.sequence(at("y0"), at("y1"))).alias("cy"))
    p = points.select("label", "point_id", "x", "y", at("x").alias("cx"), at("y").alias("cy"))
    hit = p.join(dealt, ["label", "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    return hit.groupBy("point_id").agg(F.count("*").alias("n"), F.min("box_id").alias("box_id")).where("n = 1").select("point_id", "box_id")


def lines_sum(lines: DataFrame, key: str, amount: str, totals: DataFrame, observed: str) -> DataFrame:
    """Do a document's line amounts add up to its subtotal? Exact decimals; a missing operand,
    or no line at all, leaves it unchecked."""
    s = lines.groupBy(key).agg(F.sum(amount).alias("_sum"), F.count_if(F.col(amount).isNull()).alias("_missing"))
    both = totals.join(s, key, "left")
    computed = F.when(F.coalesce("_missing", F.lit(1)) == 0, F.col("_sum"))
    return both.select(key, computed.alias("computed"), F.col(observed).alias("observed"), three_valued(F.col(observed), computed).alias("status"))


def downgrade(fields: DataFrame, issues: DataFrame) -> DataFrame:
    """Fields named by failed checks: verified becomes needs_review, reasons are appended in the
    issues' order. ``issues``: doc_id, issue_no, message, paths (array). Unknown paths are ignored."""
    told = issues.select("doc_id", "issue_no", "message", F.explode("paths").alias("path"))
    told = told.groupBy("doc_id", "path").agg(F.array_sort(F.collect_list(F.struct("issue_no", "message"))).alias("_m"))
    out = fields.join(told, ["doc_id", "path"], "left")
    status = F.when(F.col("_m").isNotNull() & (F.col("status") == "verified"), "needs_review").otherwise(F.col("status"))
    more = F.coalesce(F.transform("_m", lambda m: m["message"]), F.array().cast("array<string>"))
    return out.withColumn("status", status).withColumn("reasons", F.concat("reasons", more)).drop("_m")


def review_state(actions: DataFrame) -> DataFrame:
    """Last state per (doc_id, path) of an action log (order: seq): approve, edit, reject, reset and
    extract, a new extraction, which resets.

    The correction is that of the last edit since the last reset; approve and reject keep it.
    """
    key = Window.partitionBy("doc_id", "path")
    reset = F.max(F.when(F.col("action").isin("reset", "extract"), F.col("seq"))).over(key)
    a = actions.withColumn("_reset", F.coalesce(reset, F.lit(-1)))
    edits = F.when((F.col("action") == "edit") & (F.col("seq") > F.col("_reset")), F.struct("seq", "value"))
    last = a.groupBy("doc_id", "path").agg(F.max_by("action", "seq").alias("_last"), F.max(edits)["value"].alias("edited_value"))
    status = F.when(F.col("_last") == "approve", "approved").when(F.col("_last") == "edit", "edited").when(F.col("_last") == "reject", "rejected").otherwise("pending")
    return last.select("doc_id", "path", status.alias("review_status"), "edited_value")


def export_rows(fields: DataFrame, review: DataFrame, scope: str = "all") -> DataFrame:
    """Rows to export: rejected ones go, ``reviewed`` keeps approved and edited, a correction
    replaces the value."""
    if scope not in ("all", "reviewed"):
        raise ValueError("scope is all or reviewed")
    out = fields.join(review, ["doc_id", "path"], "left").withColumn("review_status", F.coalesce("review_status", F.lit("pending")))
    out = out.where("review_status <> 'rejected'" if scope == "all" else "review_status in ('approved', 'edited')")
    return out.select("doc_id", "path", F.coalesce("edited_value", "value").alias("value"), F.col("value").alias("original_value"), F.when(F.col("edited_value").isNull(), "extraction").otherwise("correction").alias("value_source"), F.col("status").alias("verification_status"), "review_status")


def with_provenance(rows: DataFrame, recognition: DataFrame) -> DataFrame:
    """Export rows (doc_id, page, ...) with text_mode and text_source, null for documents whose text
    is native throughout. ``recognition``: doc_id, text_mode, engine (null where none ran) and
    processed_pages (null for all pages), each document once."""
    told = recognition.select("doc_id", "text_mode", F.col("engine").alias("_engine"), F.col("processed_pages").alias("_pages"), F.lit(True).alias("_known"))
    out = rows.join(told, "doc_id", "left")
    shown = F.coalesce((F.col("text_mode") != "native") | F.col("_engine").isNotNull(), F.lit(False))
    read = F.col("_engine").isNotNull() & (F.col("_pages").isNull() | F.coalesce(F.array_contains("_pages", F.col("page")), F.lit(False)))
    source = F.when(F.col("page").isNull(), "Unlocated evidence").when(read, F.concat(F.lit("OCR: "), F.col("_engine"))).otherwise("Native PDF text")
    return out.withColumn("text_mode", F.when(shown, F.col("text_mode"))).withColumn("text_source", F.when(shown, source)).drop("_engine", "_pages", "_known")


def compare_runs(before: DataFrame, after: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Transitions of the status between two runs; rows of one run alone count as ``absent``."""
    b = before.select(*keys, F.col(status).alias("_before"), F.lit(True).alias("_in_before"))
    a = after.select(*keys, F.col(status).alias("_after"), F.lit(True).alias("_in_after"))
    both = b.join(a, keys, "full_outer")
    was = F.when(F.col("_in_before"), F.coalesce("_before", F.lit("null"))).otherwise("absent")
    now = F.when(F.col("_in_after"), F.coalesce("_after", F.lit("null"))).otherwise("absent")
    return both.groupBy(was.alias("was"), now.alias("now")).agg(F.count("*").alias("n"))


def combined_paint(words: DataFrame, key: str, state: str) -> DataFrame:
    """One paint state per key from those of its characters: unavailable, then no_contribution,
    then ambiguous_overlap if any has it; contributes only if all do, else null."""
    is_ = [F.coalesce(F.bool_or(F.col(state) == s), F.lit(False)).alias(s) for s in ("unavailable", "no_contribution", "ambiguous_overlap")]
    found = words.groupBy(key).agg(*is_, F.bool_and(F.coalesce(F.col(state) == "contributes", F.lit(False))).alias("contributes"))
    first = F.when(F.col("unavailable"), "unavailable").when(F.col("no_contribution"), "no_contribution")
    return found.select(key, first.when(F.col("ambiguous_overlap"), "ambiguous_overlap").when(F.col("contributes"), "contributes").alias("paint_state"))


def capacity(docs: DataFrame, key: str, max_count: int, max_bytes: int, max_words: int) -> DataFrame:
    """Documents, UTF-8 bytes and words a key holds, and whether another would be refused."""
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    held = docs.groupBy(key).agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), words)), F.lit(0)).alias("n_words"),
    )
    full = (F.col("n_documents") >= max_count) | (F.col("n_bytes") >= max_bytes) | (F.col("n_words") >= max_words)
    return held.withColumn("is_full", full)


def seen_in_other_half(rows: DataFrame, name: str, in_first: Column) -> DataFrame:
    """One row: distinct names of each half, and how many of the second stand in the first too."""
    halves = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.bool_or(in_first).alias("a"), F.bool_or(~in_first).alias("b"))
    return halves.agg(F.count_if("a").alias("n_first"), F.count_if("b").alias("n_second"), F.count_if(F.col("a") & F.col("b")).alias("n_both"))


def nearest_candidates(candidates: DataFrame, hints: DataFrame, key: str) -> DataFrame:
    """Per hint (key, page, top) the candidate (key, ord, page, top) nearest to it: its own page
    first, then the smallest vertical distance, then the candidates' order. Always chooses."""
    both = candidates.join(hints.select(key, F.col("page").alias("_page"), F.col("top").alias("_top")), key)
    near = F.struct((F.col("page") != F.col("_page")).alias("other"), F.abs(F.col("top") - F.col("_top")).alias("away"), "ord", "page", "top")
    best = both.groupBy(key).agg(F.min(near).alias("b"))
    return best.select(key, "b.ord", "b.page", "b.top")


def row_anchors(fields: DataFrame, *keys: str) -> DataFrame:
    """Fields with the ``anchor_path`` of their row (``keys``): the first in field order that is
    verified, strongly located and without notes; null where the row has none."""
    able = (F.col("status") == "verified") & F.col("is_strong") & (F.col("n_notes") == 0)
    first = fields.where(able).groupBy(*keys).agg(F.min_by("path", "field_no").alias("anchor_path"))
    return fields.join(first, list(keys), "left")


def row_check(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``row_status`` and ``row_reason``, decided in order. Columns: extracted,
    anchor_trusted, field_supported (booleans), and page, top, bottom, x0, x1 of the field, with
    ``a_`` before those of the anchor (null where not located)."""
    sound = lambda p: F.coalesce((F.col(p + "bottom") > F.col(p + "top")) & (F.col(p + "x1") > F.col(p + "x0")), F.lit(False))
    shared = F.least("bottom", "a_bottom") - F.greatest("top", "a_top")
    lower = F.least(F.col("bottom") - F.col("top"), F.col("a_bottom") - F.col("a_top"))
    reason = (
        F.when(~F.col("extracted"), "not_extracted")
        .when(~F.col("anchor_trusted") | F.col("a_page").isNull(), "anchor_untrusted")
        .when(~F.col("field_supported") | F.col("page").isNull(), "field_unsupported")
        .when(F.col("page") != F.col("a_page"), "other_page")
        .when(~sound("") | ~sound("a_"), "bad_geometry")
        .when((shared > 0) & (shared >= lower / 2), "one_line")
        .otherwise("other_line")
    )
    status = F.when(F.col("row_reason") == "one_line", "same_line").when(F.col("row_reason").isin("other_page", "other_line"), "separate").otherwise("unavailable")
    return pairs.withColumn("row_reason", reason).withColumn("row_status", status)


def by_value(quotes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, quote_id, word_id): words with a reading that the quote has too. Both sides carry
    ``readings``, an array of decimals; the join is on the value, so texts never meet."""
    asked = quotes.select(key, "quote_id", F.explode("readings").alias("value"))
    seen = words.select(key, "word_id", F.explode("readings").alias("value"))
    return asked.join(seen, [key, "value"]).select(key, "quote_id", "word_id").distinct()


def native_or_recognised(native: DataFrame, recognised: DataFrame, keys: list[str], mode: str = "missing") -> DataFrame:
    """Pages by their source: with ``missing``, native ones that have words and the recognised ones
    in place of those without; with ``all``, the recognised ones alone; with ``native``, the native
    ones as they are."""
    if mode not in ("native", "missing", "all"):
        raise ValueError("mode is native, missing or all")
    seen = recognised.withColumn("text_source", F.lit("recognised"))
    if mode == "all":
        return seen
    kept = native.withColumn("text_source", F.lit("native"))
    if mode == "native":
        return kept
    return kept.where("n_words > 0").unionByName(seen.join(native.where("n_words = 0").select(*keys), keys, "left_semi"))


def other_documents(values: DataFrame, pool: list[str], doc: str, most: int) -> DataFrame:
    """Evenly spread values of a pool's other documents: each document's complement within its
    pool, every n-th of it with n = max(1, size // most), by order of (document, value).

    A document's rows stand together in that order, so a rank is mapped past them by arithmetic
    and joined by equality; no document meets its whole pool. Ranks add up from counts by
    document, so a large pool is ordered by its documents alone.
    """
    counts = values.groupBy(*pool, doc).agg(F.count("*").alias("own"))
    before = Window.partitionBy(*pool).orderBy(doc).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("begin", F.coalesce(F.sum("own").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*pool, doc).orderBy("value")) - 1
    ranked = values.withColumn("within", within).join(counts, [*pool, doc]).withColumn("rank", F.col("begin") + F.col("within"))
    size = values.groupBy(*pool).agg(F.count("*").alias("size"))
    own = counts.join(size, pool)
    rest = F.col("size") - F.col("own")
    step = F.greatest(F.lit(1), F.floor(rest / most))
    at = own.where(rest > 0).select(*pool, doc, "begin", "own", F.explode(F.sequence(F.lit(0).cast("long"), rest - 1, step.cast("long"))).alias("i"))
    at = at.select(*pool, doc, F.when(F.col("i") < F.col("begin"), F.col("i")).otherwise(F.col("i") + F.col("own")).alias("rank"))
    return at.join(ranked.select(*pool, "rank", F.col(doc).alias("other_" + doc), F.col("value").alias("other_value")), [*pool, "rank"]).drop("rank")


def report_problems(fields: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """Per report: rows whose path stands before, rows of an unknown status, rows of a page that
    the document (``n_pages``) does not have."""
    paths = fields.groupBy(key, "path").agg(
        F.count("*").alias("n"),
        F.count_if(~F.coalesce(F.col("status").isin(statuses), F.lit(False))).alias("s"),
        F.count_if((F.col("page") < 1) | (F.col("page") > F.col("n_pages"))).alias("p"),
    )
    return paths.groupBy(key).agg(F.sum(F.col("n") - 1).alias("n_repeated_paths"), F.sum("s").alias("n_bad_status"), F.sum("p").alias("n_bad_page"))


def word_offsets(words: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Words stripped, blank ones dropped, with word_no, start and stop in the text that joins a
    page's (``keys``) words by single spaces."""
    bare = words.withColumn("text", F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")).where("text <> ''")
    page = Window.partitionBy(*keys).orderBy(order)
    start = F.coalesce(F.sum(F.length("text") + 1).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return bare.withColumn("word_no", (F.row_number().over(page) - 1).cast("long")).withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))


#: Upper 95 % limits of a Poisson mean by the number of events seen.
POISSON_95 = (3.0, 4.74, 6.30, 7.75, 9.15)
RESAMPLES, RESAMPLE_SEED = 2000, 1


def resampled_bounds(n: list[int], k: list[int], count: list[int]) -> tuple[float, float]:
    """Order statistics 50 and 1949 of the share of accepts over ``RESAMPLES`` resamples of
    documents, ``count`` of which have ``n`` cases and ``k`` accepts each.

    Drawing documents with replacement is drawing how often each (n, k) comes up, so a resample
    is one multinomial draw, however many documents there are.
    """
    import numpy as np

    rng = np.random.default_rng(RESAMPLE_SEED)
    both, total = np.array([k, n], np.int64), sum(count)
    step = max(1, 4_000_000 // len(n))
    shares = []
    for at in range(0, RESAMPLES, step):
        drawn = rng.multinomial(total, np.array(count) / total, min(step, RESAMPLES - at))
        accepts, cases = both @ drawn.T
        shares.append(accepts / cases)
    shares = np.sort(np.concatenate(shares))
    return float(shares[50]), float(shares[1949])


def cell_intervals(rows: DataFrame, keys: list[str], doc: str, accepted: Column) -> DataFrame:
    """Per cell of ``keys``: n, k (accepted), docs, rate, lower_95 and upper_95, with documents
    as the unit.

    Below five accepts the upper bound is the Poisson limit over the documents, at most 1, and
    the lower one null; from five on both come from a bootstrap over documents. Every cell has
    the seed's own stream, so its bounds don't depend on other cells. Null keys are cells, a
    null document is one, a null ``accepted`` is no accept.
    """
    import pandas as pd

    @F.pandas_udf("struct<lower_95:double,upper_95:double>")
    def bounds(profile):
        found = [(None, None) if p is None else resampled_bounds([x["n"] for x in p], [x["k"] for x in p], [x["c"] for x in p]) for p in profile]
        return pd.DataFrame(found, columns=["lower_95", "upper_95"], dtype="float64")

    per_doc = rows.select(*keys, F.col(doc).alias("_doc"), accepted.alias("_ok")).groupBy(*keys, "_doc").agg(F.count("*").alias("_n"), F.count_if("_ok").alias("_k"))
    alike = per_doc.groupBy(*keys, "_n", "_k").agg(F.count("*").alias("_c"))
    profile = F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col("_k").alias("k"), F.col("_c").alias("c"))))
    cells = alike.groupBy(*keys).agg(F.sum(F.col("_n") * F.col("_c")).alias("n"), F.sum(F.col("_k") * F.col("_c")).alias("k"), F.sum("_c").alias("docs"), profile.alias("_profile"))
    cells = cells.withColumn("_b", bounds(F.when(F.col("k") >= len(POISSON_95), F.col("_profile"))))
    limit = F.least(F.lit(1.0), F.get(F.array(*map(F.lit, POISSON_95)), F.col("k").cast("int")) / F.col("docs"))
    few = F.col("k") < len(POISSON_95)
    return cells.select(*keys, "n", "k", "docs", (F.col("k").cast("double") / F.col("n").cast("double")).alias("rate"), "_b.lower_95", F.when(few, limit).otherwise(F.col("_b.upper_95")).alias("upper_95"))


def run_problems(before: DataFrame, after: DataFrame, keys: list[str], inputs: list[str]) -> DataFrame:
    """One row of what keeps two runs from being compared: n_only_before, n_only_after (keys of one
    run alone), n_repeated (keys that a run has more than once) and n_unlike (shared keys whose
    ``inputs`` differ, nulls being alike). Null keys are keys."""
    def told(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias(f"_{side}_n"), F.min(F.struct(*inputs)).alias(f"_{side}_low"), F.max(F.struct(*inputs)).alias(f"_{side}_high"))

    b, a = told(before, "b"), told(after, "a").withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & b[k].eqNullSafe(a[f"_{k}"])
    both = b.join(a, same, "full_outer")
    unlike = F.col("_b_n").isNotNull() & F.col("_a_n").isNotNull() & ~(F.col("_b_low").eqNullSafe(F.col("_a_low")) & F.col("_b_high").eqNullSafe(F.col("_a_high")))
    repeated = (F.coalesce("_b_n", F.lit(0)) > 1) | (F.coalesce("_a_n", F.lit(0)) > 1)
    return both.agg(F.count_if(F.col("_a_n").isNull()).alias("n_only_before"), F.count_if(F.col("_b_n").isNull()).alias("n_only_after"), F.count_if(repeated).alias("n_repeated"), F.count_if(unlike).alias("n_unlike"))


#: Most fields and most bytes of corrections under one review.
REVIEW_FIELDS, REVIEW_BYTES = 2_000, 1 << 20


def review_problems(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, problem, n) of reviews that break a rule: decisions missing, unknown or repeated;
    states out of the four; pending with a correction or edited without; corrections of another
    type; more fields or bytes than a review may have. Sound documents have no row.

    ``fields``: doc_id, path, value (JSON). ``decisions``: doc_id, path, review_status,
    edited_value (JSON or null).
    """
    f = fields.groupBy("doc_id", "path").agg(F.first("value").alias("value"), F.lit(1).alias("_f"))
    d = decisions.groupBy("doc_id", "path").agg(F.count("*").alias("_d"), F.first(F.struct("review_status", "edited_value")).alias("s"))
    both = f.join(d, ["doc_id", "path"], "full_outer")
    state, new = F.col("s.review_status"), F.col("s.edited_value")
    held = F.col("_f").isNotNull() & F.col("_d").isNotNull()
    known = F.coalesce(state.isin("pending", "approved", "edited", "rejected"), F.lit(False))
    flags = {
        "missing": F.col("_d").isNull(),
        "unknown": F.col("_f").isNull(),
        "repeated": F.coalesce("_d", F.lit(0)) > 1,
        "state": held & ~known,
        "correction": held & known & (((state == "pending") & new.isNotNull()) | ((state == "edited") & new.isNull())),
        "type": held & new.isNotNull() & ~C.valid_correction(F.col("value"), new),
    }
    sizes = [F.count("_f").alias("_fields"), F.sum(F.octet_length(new)).alias("_bytes")]
    by = both.groupBy("doc_id").agg(*(F.count_if(x).alias(n) for n, x in flags.items()), *sizes)
    over = [F.struct(F.lit("too many fields").alias("problem"), F.when(F.col("_fields") > REVIEW_FIELDS, F.col("_fields")).alias("n")), F.struct(F.lit("too many bytes").alias("problem"), F.when(F.col("_bytes") > REVIEW_BYTES, F.col("_bytes")).alias("n"))]
    rows = F.array(*(F.struct(F.lit(n).alias("problem"), F.when(F.col(n) > 0, F.col(n)).alias("n")) for n in flags), *over)
    return by.select("doc_id", F.explode(F.filter(rows, lambda r: r["n"].isNotNull())).alias("p")).select("doc_id", "p.problem", "p.n")
