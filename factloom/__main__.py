"""Command line: replay stored extractions, or verify them against document JSON.

    python -m factloom replay EXTRACTIONS OUT
    python -m factloom verify EXTRACTIONS DOCUMENTS OUT [--rules invoice|receipt] [--edits N]
        [--number-style decimal|thousands] [--date-order mdy|dmy]

EXTRACTIONS and DOCUMENTS are folders (or patterns) of JSON files that any Spark file system may
hold; an extraction belongs to the document whose file has the same name. OUT becomes a folder with
the JSON lines ``fields`` and ``rejects``; it must not be one of the inputs.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import verify as V
from factloom.sources import readers

RULES = {name.lower(): rules for name, rules in V.DEFAULT_RULES.items()}


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.][^.]*$", "")


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    replay, check = commands.add_parser("replay"), commands.add_parser("verify")
    for sub in (replay, check):
        sub.add_argument("extractions")
    check.add_argument("documents")
    for sub in (replay, check):
        sub.add_argument("out")
    check.add_argument("--rules", choices=sorted(RULES))
    check.add_argument("--edits", type=int, default=0)
    check.add_argument("--number-style", choices=["decimal", "thousands"])
    check.add_argument("--date-order", choices=["mdy", "dmy"])
    return parser.parse_args(argv)


def run(spark: SparkSession, argv: Sequence[str] | None = None) -> None:
    args = _arguments(argv)
    inputs = [args.extractions] + ([args.documents] if args.command == "verify" else [])
    claims, refused = readers.replay(spark, args.extractions)
    out = args.out.rstrip("/")
    if args.command == "replay":
        readers.write_report(claims, f"{out}/fields", inputs)
        readers.write_report(refused, f"{out}/rejects", inputs)
        return
    name = _stem(F.col("source"))
    claims = claims.withColumn("name", name).withColumn("doc_id", F.xxhash64("name"))
    files = spark.read.format("binaryFile").load(args.documents)
    documents = files.select(F.xxhash64(_stem(F.col("path"))).alias("doc_id"), F.col("content").cast("string").alias("json"))
    words = readers.document_words(documents)
    options = V.Options(args.edits, args.number_style, args.date_order, RULES.get(args.rules, ()))
    names = claims.select("doc_id", "name").distinct()

    def named(df: DataFrame) -> DataFrame:
        return df.join(names, "doc_id").drop("doc_id")

    readers.write_report(named(V.verify(words, claims, options)), f"{out}/fields", inputs)
    left_out = named(V.rejects(words, claims)).select("name", "field_no", "path", "reason")
    whole = refused.select(_stem(F.col("source")).alias("name"), F.lit(None).cast("int").alias("field_no"), F.lit(None).cast("string").alias("path"), "reason")
    readers.write_report(left_out.unionByName(whole), f"{out}/rejects", inputs)


if __name__ == "__main__":
    run(SparkSession.builder.appName("factloom").getOrCreate())
