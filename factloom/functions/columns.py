"""Column expressions of the typed value rules; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DAY = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _joined(groups: Column) -> Column:
    return F.array_join(groups, "")


def spelling(token: Column) -> Column:
    """struct<groups, marks, sizes, joined, body, part>: a token's groups of digits, the
    separators between them, the groups' lengths, all digits, those before the last separator and
    those after it. Marks hold a ``?`` for any other character."""
    plain = F.translate(token, _ARABIC_DIGITS, "0123456789")
    marks = F.regexp_replace(F.translate(plain, "0123456789", ""), "[^.,٫٬]", "?")

    def parts(groups: Column) -> Column:
        head = F.slice(groups, 1, F.greatest(F.size(groups) - 1, F.lit(0)))
        return F.struct(groups.alias("groups"), marks.alias("marks"), F.transform(groups, F.length).alias("sizes"), _joined(groups).alias("joined"), _joined(head).alias("body"), F.try_element_at(groups, F.lit(-1)).alias("part"))

    return _let(F.split(plain, "[^0-9]"), parts)


def _roles(said: Column) -> tuple[Column, Column, Column, Column]:
    """(all separators group by comma, ... by dot, all but the last group by comma and that is a
    dot, ... by dot and that is a comma); none of them without a separator."""
    marks, n = said["marks"], F.length(said["marks"])
    head = F.substring(marks, F.lit(1), n - 1)
    all_of = lambda text, sign: (F.length(text) > 0) & (F.replace(text, F.lit(sign), F.lit("")) == "")
    ends = lambda sign: F.endswith(marks, F.lit(sign))
    return all_of(marks, ","), all_of(marks, "."), all_of(head, ",") & ends("."), all_of(head, ".") & ends(",")


def _in_threes(sizes: Column) -> Column:
    return F.get(sizes, F.lit(0)).between(1, 3) & F.forall(F.slice(sizes, 2, F.size(sizes)), lambda n: n == 3)


def _in_lakhs(sizes: Column) -> Column:
    inner = F.slice(sizes, 2, F.greatest(F.size(sizes) - 2, F.lit(0)))
    return (F.size(sizes) > 2) & F.get(sizes, F.lit(0)).between(1, 2) & (F.try_element_at(sizes, F.lit(-1)) == 3) & F.forall(inner, lambda n: n == 2)


def number_readings(token: Column, style: Column | None = None) -> Column:
    """array<struct<value decimal(38,10), places int>>: every reading of a token.

    ``style`` is ``decimal``, ``thousands`` or null: what a lone dot before three digits
    means. Unsupported spellings give an empty array.
    """
    style = F.lit(None).cast("string") if style is None else style
    none = F.array().cast("array<struct<value:decimal(38,10),places:int>>")
    return F.coalesce(_let(spelling(token), lambda said: _readings(said, style)), none)


def _readings(said: Column, style: Column) -> Column:
    sizes, part, marks = said["sizes"], said["part"], said["marks"]
    body_sizes = F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0)))
    n_part = F.length(part)
    reading = lambda text, places: F.struct(text.try_cast("decimal(38,10)").alias("value"), places.cast("int").alias("places"))
    joined = reading(said["joined"], F.lit(0))
    pointed = reading(F.concat(F.when(said["body"] == "", "0").otherwise(said["body"]), F.lit("."), part), n_part)
    commas, dots, comma_point, dot_point = _roles(said)
    arabic = F.replace(marks, F.lit("٬"), F.lit(""))
    many = F.size(sizes) > 2
    grouped = lambda s: _in_threes(s) | _in_lakhs(s)
    lone = (marks == ".") & (n_part == 3) & F.get(sizes, F.lit(0)).between(1, 3) & ~F.startswith(said["joined"], F.lit("0"))
    return (
        F.when(marks == "", F.when(F.get(sizes, F.lit(0)) > 0, F.array(joined)))
        .when(lone, F.when(style == "thousands", F.array(joined)).when(style == "decimal", F.array(pointed)).otherwise(F.array(pointed, joined)))
        .when(marks == ".", F.when(n_part > 0, F.array(pointed)))
        .when(commas & grouped(sizes), F.array(joined))
        .when(marks == ",", F.when(n_part.between(1, 2), F.array(pointed)))
        .when(comma_point & grouped(body_sizes), F.when(n_part > 0, F.array(pointed)))
        .when(dots & many & _in_threes(sizes), F.array(joined))
        .when(dot_point & _in_threes(body_sizes), F.when(n_part.between(1, 2), F.array(pointed)))
        .when((arabic == "") & (marks != "") & _in_threes(sizes), F.array(joined))
        .when((arabic == "٫") & F.endswith(marks, F.lit("٫")) & ((marks == "٫") | _in_threes(body_sizes)), F.when(n_part > 0, F.array(pointed)))
    )


def number_style(token: Column) -> Column:
    """What a token proves about the dot: ``decimal`` (comma groups, then a point and one or two
    digits), ``thousands`` (several dot groups, or dot groups, a comma and one or two digits) or
    null, as most spellings do: 4.00, 3,5 and 60.000 prove nothing."""
    return _let(spelling(token), _style)


def _style(said: Column) -> Column:
    sizes, n_part = said["sizes"], F.length(said["part"])
    body_sizes = F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0)))
    _, dots, comma_point, dot_point = _roles(said)
    cents = n_part.between(1, 2) & _in_threes(body_sizes)
    return F.when(comma_point & cents, "decimal").when((dot_point & cents) | (dots & (F.size(sizes) > 2) & _in_threes(sizes)), "thousands")


def settled(found: Column, default: Column | None = None) -> Column:
    """The one convention of a set; the default if it is empty; null if they conflict."""
    default = F.lit(None).cast("string") if default is None else default
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) == 0, default)


def agrees(value: Column, reading: Column) -> Column:
    """Does the decimal ``value`` agree with a reading? Within half of its last place, never
    more than 0.005, inclusive."""
    unit = F.when(reading["places"] >= 3, F.lit("0.5").cast("decimal(20,10)") / F.pow(F.lit(10), reading["places"]).cast("decimal(20,0)")).otherwise(F.lit("0.005").cast("decimal(20,10)"))
    return F.abs(value - reading["value"]) <= unit


def check_number(value: Column, readings: Column) -> Column:
    """``supported``, ``undecided`` (agrees with one of two readings), ``unsupported`` or
    ``unreadable`` for one token."""
    hit = F.exists(readings, lambda r: agrees(value, r))
    return F.when(F.size(readings) == 0, "unreadable").when(hit & (F.size(readings) == 1), "supported").when(hit, "undecided").otherwise("unsupported")


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def numeric_date(text: Column) -> Column:
    """struct<mdy date, dmy date>: the calendar-valid readings of a whole numeric date with one
    separator throughout; two-digit years 69 to 99 are 19xx, others 20xx."""
    fields = F.split(text, "[/.-]")
    a, b, y = (F.get(fields, k) for k in range(3))
    signs = F.translate(text, "0123456789", "")
    short = lambda x: F.length(x).between(1, 2)
    ok = signs.isin("//", "..", "--") & short(a) & short(b) & F.length(y).isin(2, 4)
    year = F.when(F.length(y) == 4, y).when(y >= "69", F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.struct(F.when(ok, _day(year, a, b)).alias("mdy"), F.when(ok, _day(year, b, a)).alias("dmy"))


def date_order(readings: Column) -> Column:
    """The order that a date valid in exactly one way proves."""
    mdy, dmy = readings["mdy"], readings["dmy"]
    return F.when(mdy.isNotNull() & dmy.isNull(), "mdy").when(dmy.isNotNull() & mdy.isNull(), "dmy")


def iso_date(text: Column) -> Column:
    """The date of a strict ISO day, else null; a trailing newline is no ISO day."""
    return F.when(text.rlike(ISO_DAY), F.try_to_date(text, "yyyy-MM-dd"))


def check_date(claim: Column, readings: Column, order: Column) -> Column:
    """Verdict of a strict ISO claim against a numeric date under the document's order."""
    day, mdy, dmy = iso_date(claim), readings["mdy"], readings["dmy"]
    open_ = mdy.isNotNull() & dmy.isNotNull() & (mdy != dmy)
    known = F.when(order == "mdy", mdy).when(order == "dmy", dmy)
    return (
        F.when(day.isNull(), "not iso")
        .when(mdy.isNull() & dmy.isNull(), "unreadable")
        .when(open_ & order.isNotNull(), F.when(day == known, "supported").otherwise("unsupported"))
        .when(open_ & ((day == mdy) | (day == dmy)), "unsettled")
        .when(open_, "unsupported")
        .otherwise(F.when(day == F.coalesce(mdy, dmy), "supported").otherwise("unsupported"))
    )


def check_bool(value: Column, evidence: Column) -> Column:
    """Does a quote give one explicit answer, after a label or alone, and is it ``value``?"""
    text = F.lower(F.trim(F.regexp_replace(evidence, r"\s+", " ")))
    said = F.when(F.endswith(text, F.lit(".")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    answer = F.regexp_extract(said, "[a-z]+$", 0)
    before = F.rtrim(F.substring(said, F.lit(1), F.length(said) - F.length(answer)))
    label = F.rtrim(F.substring(before, F.lit(1), F.length(before) - 1))
    labelled = F.endswith(before, F.lit(":")) | F.endswith(before, F.lit("="))
    odd = F.regexp_replace(label, r"[\w ()/&,'\-]", "")
    answers = F.array(*map(F.lit, ("yes", "no", "true", "false")))
    sound = labelled & (odd == "") & F.substring(label, 1, 1).rlike(r"\w") & ~F.arrays_overlap(F.split(label, r"\W+"), answers)
    clear = F.array_contains(answers, answer) & ((before == "") | sound)
    return F.when(~F.coalesce(clear, F.lit(False)), "unclear").when(value == answer.isin("yes", "true"), "supported").otherwise("unsupported")


def digits_present(value: Column, evidence: Column) -> Column:
    """Every run of digits of the value is a run of digits of the evidence."""
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(\d+)"), 1)
    return F.size(F.array_except(runs(value), runs(evidence))) == 0


def bare_text(text: Column) -> Column:
    """Letters and digits alone, lower-cased: the comparable letters of a plain string."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def plain_number(value: Column) -> Column:
    """A decimal's text without trailing zeros."""
    text = value.cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+\z", "")).otherwise(text)


def cell_type(value: Column) -> Column:
    """``n`` where a spreadsheet keeps the number exactly, else ``inlineStr``."""
    whole = value == F.floor(value)
    digits = F.length(F.regexp_replace(F.regexp_replace(plain_number(value), r"^-?0?\.?0*", ""), r"[.\-]", ""))
    return F.when(F.abs(value) >= F.lit(10**15), "inlineStr").when(whole | (digits <= 15), "n").otherwise("inlineStr")


def three_valued(observed: Column, computed: Column, tolerance: str = "0.02") -> Column:
    """``passed``, ``failed`` or, if a side is missing, ``not_checked``; inclusive tolerance."""
    return F.when(observed.isNull() | computed.isNull(), "not_checked").when(F.abs(observed - computed) <= F.lit(tolerance).cast("decimal(10,4)"), "passed").otherwise("failed")


def reason_class(reason: Column) -> Column:
    """The class of a reason: the first phrase that it contains."""
    out = F.lit("other")
    for phrase, name in reversed(REASON_CLASSES):
        out = F.when(F.contains(reason, F.lit(phrase)), name).otherwise(out)
    return out


#: Phrases of reasons and their classes, first match first.
REASON_CLASSES = (
    ("no evidence", "no evidence"),
    ("not found", "not located"),
    ("occurs", "ambiguous"),
    ("reads as", "undecided number"),
    ("unsettled", "unsettled date"),
    ("letters or digits", "letters differ"),
    ("not on the row", "row"),
    ("column", "column"),
    ("does not add up", "arithmetic"),
    ("does not show", "value"),
)


#: Words of a member's name that say it holds a date.
DATE_WORDS = ("date", "dates", "birthdate", "birthdates")


def hints_date(path: Column) -> Column:
    """Whether the last named member of a path speaks of a date."""
    member = r'(?:\["((?:[^"\\]|\\.)*)"\]|([^.\[\]]+))(?:\[\d+\])*\z'
    quoted, plain = F.regexp_extract(path, member, 1), F.regexp_extract(path, member, 2)
    parted = F.regexp_replace(F.concat(quoted, plain), "([a-z0-9])([A-Z])", "$1 $2")
    return F.arrays_overlap(F.split(F.lower(parted), r"(?U)[\W_\d]+"), F.array(*map(F.lit, DATE_WORDS)))


def row_prefix(path: Column) -> Column:
    """The longest ``...[n]`` before a further member, null for none; quoted members are atoms."""
    found = F.regexp_extract(path, r'\A((?:"(?:[^"\\]|\\.)*"|[^"])*\[\d+\])\.', 1)
    return F.when(found != "", found)


def edit_value(kind: Column, text: Column) -> Column:
    """(accepted, number) of a correction typed for a ``number``, ``boolean`` or string field:
    numbers plain and finite, booleans as ``true`` or ``false``, strings as they are."""
    typed = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    plain = typed.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    number = F.when(plain, typed.try_cast("double"))
    finite = F.abs(number) < F.lit(float("inf"))
    accepted = F.when(kind == "number", F.coalesce(finite, F.lit(False))).when(kind == "boolean", typed.isin("true", "false")).otherwise(text.isNotNull())
    return F.struct(F.coalesce(accepted, F.lit(False)).alias("accepted"), F.when((kind == "number") & finite, number).alias("number"))


def page_limit(width: Column, height: Column, scale: float, max_pixels: int) -> Column:
    """``ok``, ``bad_dimensions`` or ``too_large`` for a page drawn at ``scale``."""
    sound = [F.coalesce((x > 0) & (x < F.lit(float("inf"))), F.lit(False)) for x in (width, height)]
    pixels = F.ceil(width * F.lit(scale)).cast("double") * F.ceil(height * F.lit(scale)).cast("double")
    return F.when(~(sound[0] & sound[1]), "bad_dimensions").when(pixels > max_pixels, "too_large").otherwise("ok")


def match_strength(score: Column, letters_agree: Column, by_value: Column) -> Column:
    """(is_exact, is_strong) of a located quote."""
    return F.struct(((score >= 100) & ~by_value).alias("is_exact"), F.coalesce(letters_agree, score >= 92).alias("is_strong"))


def convention_text(words: Column) -> Column:
    """A page's text from its words (array of (text, review)), those whose paint asks for review
    blanked at full width, so that offsets hold and nothing hidden settles a convention."""
    return F.array_join(F.transform(words, lambda w: F.when(w["review"], F.repeat(F.lit(" "), F.length(w["text"]))).otherwise(w["text"])), " ")


def sound_box(x0: Column, top: Column, x1: Column, bottom: Column) -> Column:
    """Whether a box is finite with a width and a height; null sides make none."""
    finite = F.lit(True)
    for side in (x0, top, x1, bottom):
        finite = finite & (F.abs(side) < F.lit(float("inf")))
    return F.coalesce(finite & (x1 > x0) & (bottom > top), F.lit(False))


#: What may keep a word from being seen, in the order of the reasons.
PAINT_KINDS = ("unpainted", "transparent", "clipped", "no_contribution", "ambiguous_overlap", "unchecked")


def paint_kinds(mode: Column, transparent: Column, clipped: Column, state: Column) -> Column:
    """The kinds of ``PAINT_KINDS`` that hold for a word, in their order. Modes 3 and 7 paint
    nothing; a word with a mode but no observation, or an unavailable one, is unchecked unless
    another kind explains it. Null observations count as none."""
    no = F.lit(False)
    hidden, clear, cut = F.coalesce(mode.isin(3, 7), no), F.coalesce(transparent, no), F.coalesce(clipped, no)
    bare, doubtful = F.coalesce(state == "no_contribution", no), F.coalesce(state == "ambiguous_overlap", no)
    asks = F.coalesce(state != "contributes", no) | (mode.isNotNull() & state.isNull())
    unchecked = asks & ~(hidden | clear | cut | bare | doubtful)
    flags = zip((hidden, clear, cut, bare, doubtful, unchecked), PAINT_KINDS, strict=True)
    return F.array_compact(F.array(*(F.when(f, F.lit(k)) for f, k in flags)))


def json_kind(value: Column) -> Column:
    """``text``, ``number``, ``boolean``, ``null`` or ``other`` of a JSON text; null if it is none."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(kind.isNull() | value.isNull(), F.lit(None)).when(kind == "STRING", "text").when(number, "number").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("other")


def valid_correction(original: Column, correction: Column) -> Column:
    """Whether a correction (JSON) has the scalar type of the original value and, as a number,
    is finite as a double."""
    kind, new = json_kind(original), json_kind(correction)
    finite = F.abs(correction.try_cast("double")) < F.lit(float("inf"))
    same = F.when(kind == "number", (new == "number") & finite).otherwise((kind == new) & kind.isin("text", "boolean"))
    return F.coalesce(same, F.lit(False))


#: UTF-16 units that a spreadsheet cell holds.
CELL_UNITS = 32_767


def cell_text(text: Column) -> Column:
    """struct<content, problem>: a text as it stands in a spreadsheet's XML, or why it can't."""
    units = F.length(F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "xx"))
    bad = text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]")
    content = F.regexp_replace(text, "_(x[0-9a-fA-F]{4}_)", "_x005F_$1")
    for sign, said in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\r", "_x000D_")):
        content = F.replace(content, F.lit(sign), F.lit(said))
    problem = F.when(bad, "characters").when(units > CELL_UNITS, "length")
    return F.struct(F.when(problem.isNull(), content).alias("content"), problem.alias("problem"))


#: Bytes that a request's body may have, by route.
BODY_LIMITS = {"upload": 20 << 20, "archive": 64 << 20, "json": 1 << 20}


def body_verdict(route: Column, body: Column) -> Column:
    """``ok``, ``too_large`` or ``unknown_route`` of a body (binary or text) by its bytes."""
    limit = F.lit(None).cast("long")
    for name, most in BODY_LIMITS.items():
        limit = F.when(route == name, F.lit(most).cast("long")).otherwise(limit)
    return F.when(limit.isNull(), "unknown_route").when(F.coalesce(F.octet_length(body), F.lit(0)) > limit, "too_large").otherwise("ok")


def day_first(text: Column) -> Column:
    """The day of a numeric date written day first; two-digit years are 20xx."""
    fields, signs = F.split(F.trim(text), "[/.-]"), F.translate(F.trim(text), "0123456789", "")
    d, m, y = (F.get(fields, F.lit(k)) for k in range(3))
    ok = signs.isin("//", "..", "--") & F.length(d).between(1, 2) & F.length(m).between(1, 2) & F.length(y).isin(2, 4)
    return F.when(ok, _day(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), m, d))


def written_like(template: Column, day: Column) -> Column:
    """A day spelt as the numeric date ``template`` is: its sign, its leading zeros, its year."""
    fields = F.split(F.trim(template), "[/.-]")
    sign = F.substring(F.translate(F.trim(template), "0123456789", ""), 1, 1)
    two = lambda k: F.length(F.get(fields, F.lit(k))) == 2
    part = lambda k, long, short: F.when(two(k), F.date_format(day, long)).otherwise(F.date_format(day, short))
    return F.concat(part(0, "dd", "d"), sign, part(1, "MM", "M"), sign, part(2, "yy", "yyyy"))


def plain_amount(value: Column) -> Column:
    """An amount without needless zeros: whole numbers as such, others to two places at most."""
    return plain_number(F.round(value, 2).cast("decimal(18,2)"))


def json_pointer(parts: Column) -> Column:
    """The JSON Pointer of member names (array of strings); the empty text for the root."""
    escaped = F.transform(parts, lambda p: F.concat(F.lit("/"), F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))))
    return F.array_join(escaped, "")


def seed_of(*parts: Column) -> Column:
    """The seed of a random stream: the digest of the parts' texts, joined by bars."""
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def mapped_point(x: Column, y: Column, box: tuple[Column, ...], origin: tuple[Column, Column], across: tuple[Column, Column], above: tuple[Column, Column]) -> Column:
    """struct<x, y>: a page's point on the display, by where the page's lower left, lower right and
    upper left corners come to lie; null for a page box (left, bottom, right, top) without extent."""
    left, bottom, right, top = box
    u, v = (x - left) / (right - left), (y - bottom) / (top - bottom)
    at = lambda k: origin[k] + u * (across[k] - origin[k]) + v * (above[k] - origin[k])
    return F.when((right > left) & (top > bottom), F.struct(at(0).alias("x"), at(1).alias("y")))


def visible_box(rotation: Column, media: tuple[Column, ...], crop: tuple[Column, ...]) -> Column:
    """struct<x, y, width, height>: where a page's visible box (left, bottom, right, top) lies from
    the upper left corner of its turned whole; null for rotations that are no quarter turns."""
    (ml, mb, mr, mt), (left, bottom, right, top) = media, crop
    wide, high = right - left, top - bottom
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("width"), h.cast("double").alias("height"))
    return (
        F.when(rotation == 0, box(left - ml, mt - top, wide, high))
        .when(rotation == 90, box(bottom - mb, left - ml, high, wide))
        .when(rotation == 180, box(mr - right, bottom - mb, wide, high))
        .when(rotation == 270, box(mt - top, mr - right, high, wide))
    )


def crosses_clip(box: tuple[Column, ...], clip: tuple[Column, ...]) -> Column:
    """Whether a box (x0, y0, x1, y1) sticks out of a clipping box by more than a millionth; an
    empty clipping box cuts everything, a null one nothing."""
    edge = F.lit(1e-6)
    out = (box[0] < clip[0] - edge) | (box[1] < clip[1] - edge) | (box[2] > clip[2] + edge) | (box[3] > clip[3] + edge)
    empty = (clip[0] >= clip[2]) | (clip[1] >= clip[3])
    return F.coalesce(empty | out, F.lit(False))
