"""Chat formatting: schema fingerprints pick declarative mappings to canonical turns.

The *paths* of a record or table are its nested field names: ``messages[].role``. Each known
layout is a row of ``LAYOUTS`` or ``ROW_LAYOUTS``: the paths that it needs and where its turns
come from. What a record holds of a layout's paths is hashed and compared with the layout's
fingerprint; the first layout whose hash agrees maps the record, so further fields don't matter
and a missing one unmaps it. Tables are matched in the same way by the paths of their schema, when
the plan is made. Everything is DataFrame expressions.

The template writes a turn as ``### role:\\ntext</turn>\\n``. Texts keep no control string:
a backslash is doubled, ``</turn>`` becomes ``<\\/turn>`` and ``### `` becomes ``##\\# ``, and
one left-to-right pass that drops each escaping backslash restores them. In roles a backslash
is ``\\b``, a colon ``\\c``, a line feed ``\\n`` and ``<`` is ``\\l``, so that a role holds neither
the end of a head nor an end mark. Splitting at the end mark is therefore always right.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

END = "</turn>\n"
TURNS = "array<struct<role string, text string>>"
#: Code points of the pieces that a formatted text is cut into where ranges of it are read.
CHUNK = 1024
#: Escapes inside roles, in the order of writing; they are undone in the opposite one.
_ROLE_SIGNS = (("\\", "\\b"), (":", "\\c"), ("\n", "\\n"), ("<", "\\l"))


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


@dataclass(frozen=True)
class Layout:
    """``paths``: what a record must hold. ``schema``: DDL that reads it. ``turns``: SQL over the
    parsed record ``r`` giving array<struct<role string, text string>>. ``roles``: new names."""

    name: str
    paths: tuple[str, ...]
    schema: str
    turns: str
    roles: dict[str, str] = field(default_factory=dict)


def _fields(name: str, *fields: tuple[str, str]) -> Layout:
    """A layout with a field for each role; an absent or null one gives no turn."""
    items = ", ".join(f"named_struct('role', '{role}', 'text', r.{f})" for role, f in fields)
    return Layout(name, tuple(f for _, f in fields), ", ".join(f"{f} string" for _, f in fields), f"filter(array({items}), x -> x.text is not null)")


def _listed(name: str, top: str, role: str, text: str, roles: dict[str, str] | None = None) -> tuple[Layout, Layout]:
    """A layout with a list of turns, and the same with an empty list."""
    schema = f"{top} array<struct<`{role}` string, `{text}` string>>"
    full = Layout(name, (f"{top}[].{role}", f"{top}[].{text}"), schema, f"transform(r.{top}, x -> named_struct('role', x.`{role}`, 'text', x.`{text}`))", roles or {})
    return full, Layout(f"{name}, empty", (f"{top}[] empty",), schema, "cast(array() as array<struct<role string, text string>>)")


_PARTS = Layout(
    "messages with parts",
    ("messages[].content[].text", "messages[].role"),
    "messages array<struct<role string, content array<struct<text string>>>>",
    "transform(r.messages, x -> named_struct('role', x.role, 'text', concat_ws('', transform(x.content, p -> p.text))))",
)
_WITH_INPUT = Layout(
    "instruction with input",
    ("instruction", "input", "output"),
    "instruction string, input string, output string",
    "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))), named_struct('role', 'assistant', 'text', r.output))",
)
#: Declarative mappings; of several that fit, the first one counts.
LAYOUTS = (
    _PARTS,
    *_listed("messages", "messages", "role", "content"),
    *_listed("conversations", "conversations", "from", "value", {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}),
    *_listed("turns", "turns", "role", "text"),
    _WITH_INPUT,
    _fields("instruction", ("user", "instruction"), ("assistant", "output")),
    _fields("system, prompt and response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fields("prompt and response", ("user", "prompt"), ("assistant", "response")),
    _fields("prompt and completion", ("user", "prompt"), ("assistant", "completion")),
    _fields("question and answer", ("user", "question"), ("assistant", "answer")),
)
#: Tables with one row per turn: their key, order, role and text columns.
ROW_LAYOUTS = (("conv_id", "turn", "role", "text"), ("conversation_id", "position", "role", "content"))


def paths_of_type(kind: T.DataType, at: str = "") -> list[str]:
    """The nested paths of a Spark type."""
    if isinstance(kind, T.StructType):
        below = [(at + "." if at else "") + f.name for f in kind.fields]
        return below + [p for f, name in zip(kind.fields, below, strict=True) for p in paths_of_type(f.dataType, name)]
    return paths_of_type(kind.elementType, at + "[]") if isinstance(kind, T.ArrayType) else []


def paths_of_json(record: Column) -> Column:
    """The nested paths of a JSON text, null if it can't be parsed. A list without elements adds
    its path and `` empty``.

    The record's variant schema is read token by token: a name extends the path of the container
    that it stands in, and containers are kept on a stack.
    """
    said = F.schema_of_variant(F.try_parse_json(record))
    token = r"`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<|ARRAY<|>|VOID"
    tokens = F.regexp_extract_all(said, F.lit(f"({token})"), F.lit(1))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, t: Column) -> Column:
        inside = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
        bare = F.substring(t, F.lit(1), F.length(t) - 2)
        name = F.when(F.startswith(bare, F.lit("`")), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit("``"), F.lit("`"))).otherwise(bare)
        path, listed = F.concat(inside, name), F.concat(s["at"], F.lit("[]"))
        new = lambda open_, at, paths: F.struct(open_.alias("open"), at.alias("at"), paths.alias("paths"))
        return (
            F.when(F.endswith(t, F.lit(": ")), new(s["open"], path, F.array_append(s["paths"], path)))
            .when(t == "OBJECT<", new(F.array_append(s["open"], F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))), s["at"], s["paths"]))
            .when(t == "ARRAY<", new(F.array_append(s["open"], listed), listed, s["paths"]))
            .when(t == ">", new(F.slice(s["open"], 1, F.greatest(F.size(s["open"]) - 1, F.lit(0))), s["at"], s["paths"]))
            .when(F.endswith(s["at"], F.lit("[]")), new(s["open"], s["at"], F.array_append(s["paths"], F.concat(s["at"], F.lit(" empty")))))
            .otherwise(s)
        )

    return F.when(said.isNotNull(), F.aggregate(tokens, start, step, lambda s: s["paths"]))


def _projected(paths: Column, on: Iterable[str]) -> Column:
    """The fingerprint of what ``paths`` holds of ``on``."""
    shared = F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, on))))
    return F.sha2(F.array_join(shared, "\n"), 256)


def _clean(turns: Column, layout: Layout) -> Column:
    def one(t: Column) -> Column:
        role = F.coalesce(t["role"], F.lit(""))
        named = F.when(F.lit(False), role)
        for old, new in layout.roles.items():
            named = named.when(role == old, new)
        return F.struct(named.otherwise(role).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))

    return F.transform(turns, one)


def turns_of_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Add layout (null where no mapping fits), fingerprint (of the layout's paths, else of all)
    and turns to JSON records.

    Null, malformed and unmapped records keep their row, with null turns. Null texts of list
    layouts become empty, lists without elements no turns; in field layouts a null field gives no
    turn. Fields that a layout doesn't name are ignored.
    """
    out = records.withColumn("_paths", paths_of_json(F.col(record)))
    layout, turns, prints = F.lit(None).cast("string"), F.lit(None).cast(TURNS), F.sha2(F.array_join(F.array_sort("_paths"), "\n"), 256)
    for x in reversed(LAYOUTS):
        hit = _projected(F.col("_paths"), x.paths) == fingerprint(x.paths)
        layout = F.when(hit, F.lit(x.name)).otherwise(layout)
        read = F.expr(f"transform(array(from_json(`{record}`, '{x.schema}')), r -> {x.turns})[0]")
        turns = F.when(hit, _clean(read, x)).otherwise(turns)
        prints = F.when(hit, F.lit(fingerprint(x.paths))).otherwise(prints)
    return out.withColumn("fingerprint", prints).withColumn("layout", layout).withColumn("turns", turns).drop("_paths")


def _by_schema(schema: T.StructType, layouts: Iterable[Iterable[str]]) -> int | None:
    """The first of several sets of paths that the schema holds, by fingerprint."""
    paths = set(paths_of_type(schema))
    return next((i for i, x in enumerate(layouts) if fingerprint(paths & set(x)) == fingerprint(x)), None)


def turns_of_table(rows: DataFrame) -> DataFrame:
    """Add turns to a table with one row per conversation whose schema some layout fits."""
    full = [x for x in LAYOUTS if not x.name.endswith(", empty")]
    at = _by_schema(rows.schema, (x.paths for x in full))
    if at is None:
        raise ValueError(f"no mapping for the columns {sorted(rows.columns)}")
    return rows.withColumn("turns", _clean(F.expr(f"transform(array(struct(*)), r -> {full[at].turns})[0]"), full[at]))


def canonical_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table with one row per turn. Its layout is found by
    fingerprint among ROW_LAYOUTS; further columns don't matter."""
    at = _by_schema(rows.schema, ROW_LAYOUTS)
    if at is None:
        raise ValueError(f"no mapping for the columns {sorted(rows.columns)}")
    key, turn, role, text = ROW_LAYOUTS[at]
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))


def canonical_records(records: DataFrame, record: str = "record") -> DataFrame:
    """(conv_id, turn, role, text) of JSON records, numbered from 0; those without turns have no
    row."""
    told = turns_of_records(records, record).select("conv_id", F.posexplode("turns").alias("turn", "_t"))
    return told.select("conv_id", F.col("turn").cast("long").alias("turn"), "_t.role", "_t.text")


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("### "), F.lit("##\\# "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _write(role: Column, text: Column) -> tuple[Column, Column]:
    for sign, said in _ROLE_SIGNS:
        role = F.replace(role, F.lit(sign), F.lit(said))
    return F.concat(F.lit("### "), role, F.lit(":\n")), escape(text)


def format_rows(rows: DataFrame) -> DataFrame:
    """One row per conversation of a table with one row per turn: conv_id, formatted and
    loss_mask, the code point ranges of the assistants' texts in it.

    Turns are ordered by turn, then role and text; a null turn comes first. Null roles and texts
    count as empty; rows that repeat are turns of their own; a null key is a conversation too. A
    conversation becomes one row, as its format is one text; offsets are running sums, so the
    work stays linear in its length. Extra columns are ignored; empty tables give empty results.
    """
    flat = canonical_rows(rows)
    head, body = _write(F.col("role"), F.col("text"))
    flat = flat.select("conv_id", "turn", "role", "text", head.alias("_head"), body.alias("_body"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    n = F.length("_head") + F.length("_body") + len(END)
    flat = flat.withColumn("_no", F.row_number().over(order)).withColumn("_before", F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = F.coalesce("_before", F.lit(0)) + F.length("_head")
    span = F.struct(start.cast("long").alias("start"), (start + F.length("_body")).cast("long").alias("stop"))
    flat = flat.select("conv_id", "_no", F.concat("_head", "_body", F.lit(END)).alias("_text"), F.when(F.col("role") == "assistant", span).alias("_span"))
    done = flat.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_no", "_text", "_span"))).alias("_turns"))
    return done.select("conv_id", F.array_join(F.transform("_turns", lambda t: t["_text"]), "").alias("formatted"), F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_mask"))


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Add formatted to rows that hold their turns in one array (null where it is null)."""
    def one(t: Column) -> Column:
        head, body = _write(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit("")))
        return F.concat(head, body, F.lit(END))

    return df.withColumn("formatted", F.array_join(F.transform(turns, one), ""))


def read_back(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Add turns, array<struct<role, text>>, as parsed from the formatted text alone."""
    pieces = F.split(formatted, END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    at = lambda p: F.instr(p, ":\n")

    def role(p: Column) -> Column:
        said = F.substr(p, F.lit(5), at(p) - 5)
        for sign, escaped in reversed(_ROLE_SIGNS):
            said = F.replace(said, F.lit(escaped), F.lit(sign))
        return said

    text = lambda p: unescape(F.substr(p, at(p) + 2))
    return df.withColumn("turns", F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text"))))


def masked_texts(df: DataFrame, formatted: str = "formatted", mask: str = "loss_mask") -> DataFrame:
    """Add masked, the unescaped texts that the mask's ranges cover, in its order. The formatted
    text is cut into chunks once, so that a range costs its own length and not its offset."""
    size = F.lit(CHUNK)
    df = df.withColumn("_chunks", F.regexp_extract_all(F.col(formatted), F.lit(rf"(?s)(.{{1,{CHUNK}}})"), F.lit(1)))

    def cut(s: Column) -> Column:
        first, last = F.floor(s["start"] / size), F.floor((s["stop"] - 1) / size)
        around = F.array_join(F.slice("_chunks", (first + 1).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "")
        return unescape(F.substr(around, (s["start"] - first * size + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))

    return df.withColumn("masked", F.transform(mask, cut)).drop("_chunks")


def conversation_digests(rows: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, both read back from the format."""
    back = masked_texts(read_back(format_rows(rows))).withColumn("_loss", F.array_join("masked", ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.aggregate("loss_mask", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), masked.alias("masked_chars"))
