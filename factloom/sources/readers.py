"""Sources and sinks: document JSON, recogniser TSV, strict claims JSON, exports and archives."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import columns as C

BOX = "struct<x0:double,top:double,x1:double,bottom:double>"
WORD = f"struct<text:string,bbox:{BOX},start:int,end:int,render_mode:int,zero_opacity:boolean,clip_risk:boolean,raster_state:string>"
DOCUMENT = f"source string, pages array<struct<number:int,width:double,height:double,text:string,words:array<{WORD}>>>"


def document_words(json_rows: DataFrame) -> DataFrame:
    """Words of document JSON (doc_id, json): one row each, with the paint observation that asks
    for review. Absent paint fields count as unobserved."""
    pages = json_rows.select("doc_id", F.explode(F.from_json("json", DOCUMENT)["pages"]).alias("p"))
    words = pages.select("doc_id", F.col("p.number").alias("page"), F.posexplode("p.words").alias("word_no", "w"))
    w = lambda c: F.col(f"w.{c}")
    paint = C.paint_kinds(w("render_mode"), w("zero_opacity"), w("clip_risk"), w("raster_state"))
    boxes = [w(f"bbox.{c}").alias(c) for c in ("x0", "top", "x1", "bottom")]
    return words.select("doc_id", "page", "word_no", w("text").alias("text"), *boxes, (F.size(paint) > 0).alias("review_paint"), paint.alias("paint"))


def recognised_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's TSV at 144 dots an inch, in points; blanks are dropped."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    n = lambda c: F.col(c).cast("double") / 2
    kept = raw.where("text is not null and trim(text) <> ''")
    return kept.select(F.col("page_num").cast("int").alias("page"), *(F.col(c).cast("int") for c in ("block_num", "par_num", "line_num", "word_num")), F.trim("text").alias("text"), n("left").alias("x0"), n("top").alias("top"), (n("left") + n("width")).alias("x1"), (n("top") + n("height")).alias("bottom"))


def read_strict(raw: bytes) -> dict:
    """JSON object of UTF-8 (with or without mark) or UTF-16; refuses repeated members, numbers
    that are not finite, lone surrogates and other roots."""
    text = raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")

    def members(pairs: list) -> dict:
        out: dict = {}
        for name, value in pairs:
            if name in out:
                raise ValueError(f"the member {name!r} is repeated")
            out[name] = value
        return out

    def refuse(token: str):
        raise ValueError(f"{token} is not a finite number")

    data = json.loads(text, object_pairs_hook=members, parse_constant=refuse)
    if not isinstance(data, dict):
        raise ValueError("the root is not an object")
    json.dumps(data, ensure_ascii=False).encode("utf-8")
    return data


def check_destination(spark: SparkSession, path: str, protected: list[str]) -> None:
    """Refuse to write a report onto one of its inputs, inside it or above it; paths are compared
    after the file system has resolved them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def resolved(p: str) -> str:
        found = jvm.org.apache.hadoop.fs.Path(p)
        fs = found.getFileSystem(conf)
        whole = (fs.resolvePath(found) if fs.exists(found) else fs.makeQualified(found)).toString()
        return whole.rstrip("/") + "/"

    target = resolved(path)
    for source in map(resolved, protected):
        if target.startswith(source) or source.startswith(target):
            raise ValueError("a report must not be written onto its inputs")


def write_report(rows: DataFrame, path: str, protected: list[str]) -> None:
    """Report rows as JSON lines; the writer's commit leaves no partial report behind."""
    check_destination(rows.sparkSession, path, protected)
    rows.write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Export rows as CSV; booleans in lower case come from the cast."""
    rows.select([F.col(c).cast("string").alias(c) for c in rows.columns]).write.csv(path, header=True)


_ESCAPE_LIKE = re.compile("_(x[0-9a-fA-F]{4}_)")
_LEAST_NORMAL = 2.2250738585072014e-308


def keeps_number(value: int | float) -> bool:
    """Whether a spreadsheet keeps a number exactly: 15 digits, no subnormals."""
    if isinstance(value, int):
        return abs(value) < 10**15
    mantissa = repr(abs(value)).partition("e")[0].replace(".", "")
    return abs(value) < 1e15 and (value == 0 or abs(value) >= _LEAST_NORMAL) and len(mantissa.strip("0")) <= 15


def replay(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims, rejects) of stored extractions, one JSON file each: the object under ``data`` or
    the file's own. Claims: source, field_no, path, value (JSON), evidence, page, declared_kind, in
    the order of the file. Rejects: source and reason of files that the strict reader refuses or
    that hold bare values. Files are read whole, each in one task."""
    from factloom.operators.verify import flatten

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    data = read_strict(raw)
                    held = flatten(data.get("data", data))
                    out += [(source, i, c.path, json.dumps(c.value, ensure_ascii=False), [str(x) for x in c.evidence], c.page, c.declared_kind, None) for i, c in enumerate(held)]
                except (ValueError, TypeError, RecursionError) as problem:
                    out.append((source, None, None, None, None, None, None, str(problem)[:500]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CLAIMS, strict=True)] if out else [pa.array([], f.type) for f in _CLAIMS], schema=_CLAIMS)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "source string, field_no int, path string, value string, evidence array<string>, page int, declared_kind string, reason string")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("source", "reason")


_CLAIMS = pa.schema([("source", pa.string()), ("field_no", pa.int32()), ("path", pa.string()), ("value", pa.string()), ("evidence", pa.list_(pa.string())), ("page", pa.int32()), ("declared_kind", pa.string()), ("reason", pa.string())])


def xlsx(rows: list[dict], columns: list[str]) -> bytes:
    """A one-sheet workbook. Numbers a spreadsheet can't keep exactly become text; control
    characters and texts beyond 32,767 units are refused."""
    def cell(value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        finite = isinstance(value, int) or (isinstance(value, float) and abs(value) < float("inf"))
        if finite and keeps_number(value):
            return f'<c t="n"><v>{value!r}</v></c>'
        if not finite and not isinstance(value, str):
            raise ValueError("the value can't stand in a cell")
        text = str(value)
        if any(ord(c) < 32 and c not in "\t\n\r" or 0xD800 <= ord(c) < 0xE000 or ord(c) in (0xFFFE, 0xFFFF) for c in text) or len(text.encode("utf-16-le")) > 2 * C.CELL_UNITS:
            raise ValueError("the text can't stand in a cell")
        kept = escape(_ESCAPE_LIKE.sub(r"_x005F_\1", text)).replace("\r", "_x000D_")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{kept}</t></is></c>'

    if len(rows) > 1_048_575:
        raise ValueError("too many rows for a sheet")
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [columns, *([x.get(c) for c in columns] for x in rows)])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="fields" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def pack_archive(members: dict[str, bytes]) -> bytes:
    """A ZIP of the members with a manifest of their sizes and SHA-256 digests."""
    manifest = {n: {"bytes": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in members.items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in {**members, "manifest.json": json.dumps(manifest, sort_keys=True).encode()}.items():
            z.writestr(name, body)
    return out.getvalue()


def open_archive(raw: bytes, limit: int = 64 << 20) -> dict[str, bytes]:
    """The members of an archive; refuses missing, extra, oversized and altered ones."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len({i.filename for i in infos}) != len(infos) or any(i.file_size > limit for i in infos):
            raise ValueError("repeated or oversized members")
        body = {i.filename: z.read(i) for i in infos}
    manifest = read_strict(body.pop("manifest.json"))
    if manifest.keys() != body.keys() or any(m["sha256"] != hashlib.sha256(body[n]).hexdigest() for n, m in manifest.items()):
        raise ValueError("the members don't match the manifest")
    return body
