"""Numbers, dates and conventions of whole texts: the kernels of ``functions.numbers`` on Arrow
batches, one row in, one row out, without a shuffle."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import numbers, text


def _per_text(df: DataFrame, column: str, kernel: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """``df`` without its text column, with the kernel's values beside each row."""
    kept = [c for c in df.columns if c != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema] + [f"{n} {t}" for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(batch.num_columns - 1).to_pylist()
            rows = [kernel(x or "") for x in said]
            made = [pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*kept, *(n for n, _, _ in fields)])

    return df.select(*kept, F.col(column).cast("string").alias("_said")).mapInArrow(run, schema)


def conventions(df: DataFrame, column: str = "text") -> DataFrame:
    """Replace the text by number_styles and date_orders (sorted arrays): what its own spellings
    prove. Null and empty texts prove nothing."""
    strings = pa.list_(pa.string())
    return _per_text(df, column, lambda t: (sorted(numbers.styles(t)), sorted(numbers.date_orders(t))), [("number_styles", "array<string>", strings), ("date_orders", "array<string>", strings)])


def all_numbers(df: DataFrame, column: str = "text") -> DataFrame:
    """Replace the text by numbers (array<double>): the first reading of each number in order,
    rates and undecidable groups aside. Null and empty texts have none."""
    return _per_text(df, column, lambda t: ([float(v) for v in numbers.all_numbers(t)],), [("numbers", "array<double>", pa.list_(pa.float64()))])


def checked_strings(df: DataFrame, value: str = "value", evidence: str = "evidence", tolerance: int = 0) -> DataFrame:
    """Replace value and evidence by supported and reason: whether the evidence says the value in
    its own letters and digits, in whole words. Null ones count as empty."""
    kept = [c for c in df.columns if c not in (value, evidence)]
    both = df.select(*kept, F.to_json(F.array(F.coalesce(value, F.lit("")), F.coalesce(evidence, F.lit("")))).alias("_both"))
    return _per_text(both, "_both", lambda t: text.check_string(*json.loads(t), tolerance), [("supported", "boolean", pa.bool_()), ("reason", "string", pa.string())])


def parsed_dates(df: DataFrame, column: str = "text") -> DataFrame:
    """Replace the text by day: the date that it is or shows first, null for none."""
    return _per_text(df, column, lambda t: (numbers.parse_date(t),), [("day", "date", pa.date32())])
