"""Review archives: a document, its extraction and the decisions on it, restored by judging anew."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from factloom.operators import grounding as G
from factloom.operators.verify import Claim, Options, Result, check_limits, flatten, verify_document
from factloom.sources.readers import open_archive, pack_archive, read_strict

VERSIONS = (1, 2)
MEMBERS = {"document.json", "extraction.json", "review.json", "about.json"}
#: Most fields under review, bytes of all corrections, bytes of a member, letters of a file name.
MAX_FIELDS, MAX_CORRECTIONS, MAX_MEMBER, MAX_NAME = 2_000, 1 << 20, 20 << 20, 255
STATES = ("pending", "approved", "edited", "rejected")


@dataclass
class Restored:
    name: str
    text_mode: str
    results: list[Result]
    review: dict[str, tuple[str, object]]


def fits(original: object, correction: object) -> bool:
    """Whether a correction has the original's scalar type and, as a number, is finite."""
    if isinstance(original, bool) or isinstance(correction, bool):
        return isinstance(original, bool) and isinstance(correction, bool)
    if isinstance(original, str):
        return isinstance(correction, str)
    if not isinstance(correction, (int, float)):
        return False
    try:
        return math.isfinite(float(correction))
    except OverflowError:
        return False


def check_review(claims: list[Claim], decisions: dict) -> dict[str, tuple[str, object]]:
    """(state, correction) by path of decisions that name each field once, pending without a
    correction, edited with one of the field's type, all of them within the limits."""
    if len(claims) > MAX_FIELDS:
        raise ValueError("too many fields to review")
    if decisions.keys() != {c.path for c in claims} or len(decisions) != len(claims):
        raise ValueError("the decisions don't name every field once")
    out, size = {}, 0
    for claim in claims:
        said = decisions[claim.path]
        if not isinstance(said, dict) or set(said) != {"status", "edited_value"} or said["status"] not in STATES:
            raise ValueError(f"the decision on {claim.path} is malformed")
        state, correction = said["status"], said["edited_value"]
        if correction is None and state == "edited" or correction is not None and state == "pending":
            raise ValueError(f"the correction of {claim.path} doesn't fit its state")
        if correction is not None:
            if not fits(claim.value, correction):
                raise ValueError(f"the correction of {claim.path} has another type")
            size += len(json.dumps(correction, ensure_ascii=False).encode("utf-8"))
        out[claim.path] = state, correction
    if size > MAX_CORRECTIONS:
        raise ValueError("the corrections are too long")
    return out


def pages_of(document: dict) -> list[G.Page]:
    """The pages of document JSON."""
    pages = []
    for page in document["pages"]:
        words = []
        for w in page["words"]:
            box = w["bbox"]
            kinds = G.paint_kinds(w.get("render_mode"), w.get("zero_opacity"), w.get("clip_risk"), w.get("raster_state"))
            words.append(G.Word(w["text"], box["x0"], box["top"], box["x1"], box["bottom"], w["start"], w["end"], bool(kinds), kinds))
        pages.append(G.Page(page["number"], words, page["text"]))
    return pages


def pack_review(name: str, document: dict, extraction: dict, review: dict, text_mode: str = "native") -> bytes:
    about = {"version": VERSIONS[-1], "name": name, "text_mode": text_mode}
    parts = {"document.json": document, "extraction.json": extraction, "review.json": review, "about.json": about}
    return pack_archive({n: json.dumps(x, ensure_ascii=False, allow_nan=False).encode("utf-8") for n, x in parts.items()})


def restore_review(raw: bytes, options: Options | None = None) -> Restored:
    """A review from its archive. Members, digests, types and decisions are checked; verdicts are
    not read but computed from the document again. The first version has native text alone."""
    members = open_archive(raw, MAX_MEMBER)
    if members.keys() != MEMBERS:
        raise ValueError("the archive's members are not those of a review")
    read = {n: read_strict(b) for n, b in members.items()}
    about = read["about.json"]
    version, name = about.get("version"), about.get("name")
    if version not in VERSIONS or isinstance(version, bool):
        raise ValueError("the archive has another version")
    if not isinstance(name, str) or not 0 < len(name) <= MAX_NAME:
        raise ValueError("the archive's name is empty or too long")
    mode = about.get("text_mode", "native") if version > 1 else "native"
    if mode not in ("native", "missing", "all"):
        raise ValueError("the text mode is unknown")
    claims = flatten(read["extraction.json"])
    pages = pages_of(read["document.json"])
    check_limits(pages)
    return Restored(name, mode, verify_document(claims, pages, options), check_review(claims, read["review.json"]))
