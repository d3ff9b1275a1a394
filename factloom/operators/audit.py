"""Audits of invoices and receipts: every check that applies, passed, failed or not, in order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C

MONEY = "decimal(30,6)"


def _tolerance(tolerance: str | float) -> Decimal:
    value = Decimal(str(tolerance))
    if not value.is_finite() or value < 0:
        raise ValueError("a tolerance is finite and not negative")
    return value


def _check(no: Column, rule: str, fields: Column, observed: Column, computed: Column, tolerance: Decimal) -> Column:
    limit = F.lit(str(tolerance)).cast("decimal(20,6)")
    status = F.when(observed.isNull() | computed.isNull(), "not_checked").when(F.abs(observed - computed) <= limit, "passed").otherwise("failed")
    known = status != "not_checked"
    money = lambda x: F.when(known, x).cast(MONEY)
    return F.struct(no.cast("long").alias("check_no"), F.lit(rule).alias("rule"), fields.alias("fields"), status.alias("status"), money(observed).alias("observed"), money(computed).alias("computed"), money(observed - computed).alias("difference"))


def audit(headers: DataFrame, items: DataFrame, kind: str = "invoice", tolerance: str | float = "0.02") -> DataFrame:
    """One row per check: doc_id, check_no (from 0, in the order of the rules), rule, fields (paths
    that it compares), status (passed, failed, not_checked), observed, computed and difference.

    ``headers``: doc_id, subtotal, tax, total and, for invoices, issue_date and due_date (texts).
    ``items``: doc_id, item_no (from 0) and amount, for invoices quantity and unit_price. Amounts
    are decimals; null is missing, never zero, and a check with a missing operand or a sum of no
    items is not_checked. An invoice has a check for each item, then the sum of the items, the sum
    of subtotal and tax, and the order of its dates; a receipt the two sums. ``tolerance`` is
    absolute and included. A sum over a document's items is combined before the shuffle; items
    without a document are left out.
    """
    limit = _tolerance(tolerance)
    name, money = ("line_items" if kind == "invoice" else "items"), lambda c: F.col(c).cast("decimal(18,6)")
    path = lambda member: F.concat(F.lit(f"{name}["), F.col("item_no").cast("string"), F.lit(f"].{member}"))
    sums = items.groupBy("doc_id").agg(F.count("*").alias("_n"), F.count("amount").alias("_known"), F.sum(money("amount")).cast(MONEY).alias("_sum"))
    docs = headers.join(sums, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    whole = F.when((F.col("_n") > 0) & (F.col("_n") == F.col("_known")), F.col("_sum"))
    amounts = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("_n")), lambda i: i < F.col("_n")), lambda i: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].amount")))
    first = F.col("_n") if kind == "invoice" else F.lit(0)
    made = [
        _check(first, f"{kind}.items_subtotal", F.array_append(amounts, F.lit("subtotal")), money("subtotal"), whole, limit),
        _check(first + 1, f"{kind}.subtotal_tax_total", F.array(*map(F.lit, ("subtotal", "tax", "total"))), money("total"), money("subtotal") + money("tax"), limit),
    ]
    if kind == "invoice":
        issue, due = C.iso_date(F.col("issue_date")), C.iso_date(F.col("due_date"))
        none = F.lit(None).cast(MONEY)
        status = F.when(issue.isNull() | due.isNull(), "not_checked").when(due < issue, "failed").otherwise("passed")
        made.append(F.struct((first + 2).cast("long").alias("check_no"), F.lit("invoice.due_date_order").alias("rule"), F.array(F.lit("issue_date"), F.lit("due_date")).alias("fields"), status.alias("status"), none.alias("observed"), none.alias("computed"), none.alias("difference")))
    out = docs.select("doc_id", F.explode(F.array(*made)).alias("c")).select("doc_id", "c.*")
    if kind != "invoice":
        return out
    extended = _check(F.col("item_no"), "invoice.line_extension", F.array(path("quantity"), path("unit_price"), path("amount")), money("amount"), (money("quantity") * money("unit_price")).cast(MONEY), limit)
    lines = items.join(headers.select("doc_id"), "doc_id", "left_semi").select("doc_id", extended.alias("c")).select("doc_id", "c.*")
    return lines.unionByName(out)


def issues(checks: DataFrame) -> DataFrame:
    """The failed checks, as ``relational.downgrade`` takes them: doc_id, issue_no, message, paths."""
    failed = checks.where("status = 'failed'")
    message = F.when(F.col("rule").endswith("due_date_order"), "the due date is before the issue date").otherwise(F.concat(F.lit("the "), F.element_at(F.split("rule", "[.]"), -1), F.lit(" does not add up")))
    return failed.select("doc_id", F.col("check_no").alias("issue_no"), message.alias("message"), F.col("fields").alias("paths"))
