"""Grounding: where a quote stands in a document, by a ladder of ever weaker rungs.

A rung is used only if no page matched an earlier one: exact, case-folded, by value, best
fuzzy window. The kernels work on one document at a time; documents are dealt by doc_id.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from math import inf

from factloom.functions import numbers, text
from factloom.functions.columns import PAINT_KINDS

STRONG_FROM, FUZZY_FROM = 92.0, 70.0


@dataclass(frozen=True)
class Word:
    text: str
    x0: float
    top: float
    x1: float
    bottom: float
    start: int
    stop: int
    review_paint: bool = False
    paint: tuple[str, ...] = ()


def paint_kinds(mode: int | None, transparent: bool | None, clipped: bool | None, state: str | None) -> tuple[str, ...]:
    """What may keep a word from being seen, as ``columns.paint_kinds`` says it."""
    flags = (mode in (3, 7), bool(transparent), bool(clipped), state == "no_contribution", state == "ambiguous_overlap")
    kinds = tuple(k for k, f in zip(PAINT_KINDS, flags, strict=False) if f)
    asks = state not in (None, "contributes") or (mode is not None and state is None)
    return kinds or (("unchecked",) if asks else ())


def laid_out(said: str, start: int, words) -> str:
    """The text with line breaks for the spaces between words on other rows, or between digits
    at least one and a half heights apart; invalid geometry changes nothing."""
    chars = list(said)
    for a, b in zip(words, words[1:]):
        at = a.stop - start
        if not (0 <= at < len(chars)) or chars[at] != " " or not _sound((a, b)):
            continue
        shared = min(a.bottom, b.bottom) - max(a.top, b.top)
        apart = b.x0 - a.x1 >= 1.5 * max(a.bottom - a.top, b.bottom - b.top)
        if shared < min(a.bottom - a.top, b.bottom - b.top) / 2 or (apart and a.text[-1:].isdigit() and b.text[:1].isdigit()):
            chars[at] = "\n"
    return "".join(chars)


@dataclass
class Page:
    number: int
    words: list[Word]
    text: str = ""

    def __post_init__(self) -> None:
        self.text = self.text or " ".join(w.text for w in self.words)
        self.plain, self.source = text.normalise(self.text)
        self._fold: tuple[str, list[int]] | None = None
        self._tokens: list[tuple[int, int, numbers.Token]] | None = None

    @property
    def fold(self) -> tuple[str, list[int]]:
        self._fold = self._fold or text.folded(self.plain, self.source)
        return self._fold

    @property
    def tokens(self) -> list[tuple[int, int, numbers.Token]]:
        """Number tokens with their ranges in ``text``."""
        if self._tokens is None:
            self._tokens = [(t.start, t.stop, t) for t in numbers.tokens(laid_out(self.text, 0, self.words))]
        return self._tokens

    def touched(self, start: int, stop: int) -> list[Word]:
        return [w for w in self.words if w.start < stop and w.stop > start]


@dataclass(frozen=True)
class Match:
    quote: str
    page: int
    start: int
    stop: int
    score: float
    found: str
    words: tuple[Word, ...]
    letters_agree: bool | None = None
    by_value: bool = False
    boxes: list = field(default_factory=list, compare=False)

    @property
    def strong(self) -> bool:
        return self.letters_agree if self.letters_agree is not None else self.score >= STRONG_FROM

    @property
    def exact(self) -> bool:
        return self.score >= 100 and not self.by_value


def page_of(number: int, line: str, top: float = 0.0) -> Page:
    """A one-line page, a point per character: the smallest document."""
    words, at = [], 0
    for w in line.split():
        words.append(Word(w, float(at), top, float(at + len(w)), top + 10, at, at + len(w)))
        at += len(w) + 1
    return Page(number, words)


def letters(value: str) -> str:
    """Comparable letters: case-folded alphanumerics, separators between digits, and marks for
    signs and rates at the start of their numbers."""
    plain = text.normalise(value)[0].casefold()
    marks: dict[int, str] = {}
    for t in numbers.tokens(plain):
        marks[t.start] = ("-" if t.negative else "") + ("%" if t.rate else "")
    out = []
    for i, c in enumerate(plain):
        out.append(marks.get(i, ""))
        if c.isalnum() or (c in ".,'/٫٬:" and 0 < i < len(plain) - 1 and plain[i - 1].isdigit() and plain[i + 1].isdigit()):
            out.append(c)
    return "".join(out)


def _leaves_letters(page: Page, words: list[Word], start: int, stop: int) -> bool:
    rest = page.text[words[0].start : start] + page.text[stop : words[-1].stop]
    return any(c.isalnum() for c in unicodedata.normalize("NFKC", rest))


def _clipped(page: Page, start: int, stop: int) -> tuple[int, int] | None:
    """The range with every number it touches whole, if it cuts a sign, bracket or rate off."""
    lo, hi, cut = start, stop, False
    for a, b, t in page.tokens:
        if a < hi and b > lo and (a < lo or b > hi):
            inside = [r for x in numbers.tokens(page.text[max(a, start) : min(b, stop)]) for r in x.readings()]
            if any(c.isdecimal() for c in page.text[max(a, start) : min(b, stop)]) and {v for v, _ in inside} != {v for v, _ in t.readings()}:
                cut = True
            lo, hi = min(lo, a), max(hi, b)
    return (lo, hi) if cut else None


def _literal(quote: str, page: Page, fold: bool) -> list[Match]:
    needle = text.normalise(quote)[0]
    hay, source = page.fold if fold else (page.plain, page.source)
    needle = needle.casefold() if fold else needle
    out, at = [], -1
    while needle and (at := hay.find(needle, at + 1)) >= 0:
        last = at + len(needle)
        if (at and source[at] == source[at - 1]) or (last < len(source) and source[last] == source[last - 1]):
            continue  # half of a character
        start, stop = source[at], source[last - 1] + 1
        words = page.touched(start, stop)
        if not words or _leaves_letters(page, words, start, stop):
            continue
        wide = _clipped(page, start, stop)
        if wide:
            words = page.touched(*wide)
            found = page.text[wide[0] : wide[1]]
            out.append(Match(quote, page.number, *wide, text.indel_ratio(needle, text.normalise(found)[0]), found, tuple(words), False))
        else:
            out.append(Match(quote, page.number, start, stop, 99.0 if fold else 100.0, page.text[start:stop], tuple(words), True))
    return out


def is_literal(quote: str, pages: list[Page]) -> bool:
    """Whether some page has the quote literally or case-folded, whole or as a part of a number."""
    return any(_literal(quote, p, fold) for fold in (False, True) for p in pages)


def _amount(word: str) -> list:
    word = word.strip().rstrip("*:;")
    found = numbers.tokens(word)
    return [v for v, _ in found[0].readings()] if len(found) == 1 and (found[0].start, found[0].stop) == (0, len(word)) and not found[0].count else []


def _by_value(quote: str, page: Page) -> list[Match]:
    plain = text.normalise(quote)[0]
    out = []
    amount = _amount(plain) if " " not in plain else []
    if amount:
        for w in page.words:
            if set(amount) & set(_amount(text.normalise(w.text)[0])):
                out.append(Match(quote, page.number, w.start, w.stop, 100.0, w.text, (w,), True, True))
        return out
    whole = [d for a, b, d in numbers.dates_in(plain) if (a, b) == (0, len(plain))]
    if whole:
        for a, b, days in numbers.dates_in(page.plain):
            if days & whole[0]:
                start, stop = page.source[a], page.source[b - 1] + 1
                words = page.touched(start, stop)
                if words and not _leaves_letters(page, words, start, stop):
                    out.append(Match(quote, page.number, start, stop, 100.0, page.text[start:stop], tuple(words), True, True))
    return out


def _fuzzy(quote: str, page: Page) -> Match | None:
    needle = text.normalise(quote)[0].casefold()
    hay, source = page.fold
    score, a, b = text.best_window(needle, hay, FUZZY_FROM)
    if score < FUZZY_FROM or a >= b:
        return None
    start, stop = source[a], source[b - 1] + 1
    words = page.touched(start, stop)
    if not words:
        return None
    halves = (a and source[a] == source[a - 1]) or (b < len(source) and source[b] == source[b - 1])
    if halves or _leaves_letters(page, words, start, stop) or _clipped(page, start, stop):
        start, stop = words[0].start, words[-1].stop
        for x, y, _ in page.tokens:
            if x < stop and y > start:
                start, stop = min(start, x), max(stop, y)
        words = page.touched(start, stop)
        score = text.indel_ratio(needle, text.normalise(page.text[start:stop])[0].casefold())
        if score < FUZZY_FROM:
            return None
    found = page.text[start:stop]
    return Match(quote, page.number, start, stop, score, found, tuple(words), letters(quote) == letters(found))


def candidates(quote: str, pages: list[Page], hint: int | None = None) -> list[Match]:
    """All places of a quote on the first rung that has any; a hint orders pages, it never
    filters."""
    pages = sorted(pages, key=lambda p: hint is not None and p.number != hint)
    for rung in (lambda p: _literal(quote, p, False), lambda p: _literal(quote, p, True), lambda p: _by_value(quote, p)):
        found = [m for p in pages for m in rung(p)]
        if found:
            return found
    best = None
    for p in pages:
        m = _fuzzy(quote, p)
        if m and (best is None or m.score > best.score):
            best = m
    return [best] if best else []


def ground_quote(quote: str, pages: list[Page], hint: int | None = None) -> Match | None:
    found = candidates(quote, pages, hint)
    return max(found, key=lambda m: m.score) if found else None


def nearest_candidate(found: list[Match], anchor: Match) -> Match | None:
    """The candidate nearest the anchor: its page first, then the smaller vertical distance."""
    top = lambda m: sum(w.top for w in m.words) / len(m.words) if m.words else 0.0
    return min(found, key=lambda m: (m.page != anchor.page, abs(top(m) - top(anchor))), default=None)


def _sound(words) -> bool:
    return bool(words) and all(-inf < w.x0 < w.x1 < inf and -inf < w.top < w.bottom < inf for w in words)


def on_one_row(a: Match, b: Match) -> bool:
    if a.page != b.page or not _sound(a.words) or not _sound(b.words):
        return False
    top, bottom = max(w.top for w in a.words + b.words), min(w.bottom for w in a.words + b.words)
    low = min(w.bottom - w.top for w in a.words + b.words)
    return bottom - top > 0 and bottom - top >= low / 2


def row_candidate(found: list[Match], anchor: Match) -> Match | None:
    near = [m for m in found if on_one_row(m, anchor)]
    return near[0] if len(near) == 1 else None


def line_boxes(match: Match, gap: float = 3.0) -> list[tuple[float, float, float, float]]:
    """One box (x0, top, x1, bottom) per line of the match."""
    out: list[list[float]] = []
    first = 0.0
    for w in sorted(match.words, key=lambda w: (w.top, w.x0)):
        if not out or abs(w.top - first) > gap:
            out.append([w.x0, w.top, w.x1, w.bottom])
            first = w.top
        else:
            b = out[-1]
            b[:] = [min(b[0], w.x0), min(b[1], w.top), max(b[2], w.x1), max(b[3], w.bottom)]
    return [tuple(b) for b in out]
