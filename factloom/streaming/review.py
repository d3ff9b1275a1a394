"""Review decisions as a stream: the last state of every field, keyed by document and path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import columns as C

#: Bytes of one correction, at most.
EDIT_BYTES = 1 << 20
STATE = "status string, edited_value string, seq long"
OUT = "doc_id long, path string, review_status string, edited_value string"


def next_state(status: str, edited: str | None, action: str, value: str | None) -> tuple[str, str | None]:
    if action == "approve":
        return "approved", edited
    if action == "edit":
        return "edited", value
    if action == "reject":
        return "rejected", edited
    if action in ("reset", "extract"):  # a new extraction begins the review again
        return "pending", None
    raise ValueError(f"unknown action {action!r}")


def accepted(actions: DataFrame, fields: DataFrame) -> DataFrame:
    """The actions (doc_id, path, seq, action, value) on known fields, without edits whose value
    (JSON) has another type than the field's or is not finite or beyond ``EDIT_BYTES``. ``fields``
    (doc_id, path, value as JSON, each field once) is static; ``actions`` may be a stream."""
    known = fields.select("doc_id", "path", F.col("value").alias("_original"))
    sound = C.valid_correction(F.col("_original"), F.col("value")) & (F.octet_length("value") <= EDIT_BYTES)
    return actions.join(known, ["doc_id", "path"]).where((F.col("action") != "edit") | F.coalesce(sound, F.lit(False))).drop("_original")


def review_stream(actions: DataFrame) -> DataFrame:
    """Streaming (doc_id, path, seq, action, value) to the state after each micro-batch.

    Within a micro-batch actions apply in the order of seq; an action older than the state is
    ignored, so replays change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, edited, seen = state.get if state.exists else ("pending", None, -1)
        for x in pd.concat(list(frames)).sort_values("seq").itertuples():
            if x.seq > seen:
                status, edited = next_state(status, edited, x.action, x.value)
                seen = int(x.seq)
        state.update((status, edited, seen))
        yield pd.DataFrame([(key[0], key[1], status, edited)], columns=["doc_id", "path", "review_status", "edited_value"])

    return actions.groupBy("doc_id", "path").applyInPandasWithState(step, OUT, STATE, "update", "NoTimeout")
