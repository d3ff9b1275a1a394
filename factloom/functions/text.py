"""Text kernels: normalisation with offsets, comparable letters, similarity, said-in checks."""

from __future__ import annotations

import re
import unicodedata

#: Quotes and dashes that count as their plain forms.
PLAIN_FORMS = dict(zip("‘’‚‛“”„‟«»‐‑‒–—−", "''''\"\"\"\"\"\"------", strict=True))
MIN_SIMILARITY = 82.0
TOLERANT_LETTERS = 12


def normalise(text: str) -> tuple[str, list[int]]:
    """Compatibility forms per character, plain quotes and dashes, single inner spaces, and the
    offset in ``text`` of every character."""
    if text.isascii():  # all of these are plain but for the blanks
        plain = " ".join(parts := text.split())
        if plain == text:
            return text, list(range(len(text)))
        at, offsets = 0, []
        for part in parts:
            begin = text.index(part, at)
            if at:
                offsets.append(at)
            at = begin + len(part)
            offsets += range(begin, at)
        return plain, offsets
    chars: list[str] = []
    source: list[int] = []
    for at, char in enumerate(text):
        for piece in PLAIN_FORMS.get(char) or unicodedata.normalize("NFKC", char):
            if not piece.isspace():
                chars.append(piece)
                source.append(at)
            elif chars and chars[-1] != " ":
                chars.append(" ")
                source.append(at)
    if chars and chars[-1] == " ":
        chars.pop()
        source.pop()
    return "".join(chars), source


def folded(text: str, source: list[int]) -> tuple[str, list[int]]:
    """Case-folded text; characters that expand keep their offset."""
    if text.isascii():
        return text.lower(), source
    parts = [c.casefold() for c in text]
    return "".join(parts), [at for at, p in zip(source, parts, strict=True) for _ in p]


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", normalise(text)[0].casefold())


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - indel distance / total length), the distance by bit-parallel LCS."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    common = len(a) - bin(rows).count("1")
    return 200.0 * common / (len(a) + len(b))


def best_window(short: str, long: str, least: float = 0.0) -> tuple[float, int, int]:
    """(score, start, stop) of the window of ``long`` most like ``short``; earliest of equals.

    Windows have the length of ``short``, or less at the text's ends. A bag-of-characters
    bound, which never undercuts the score, skips windows that can't win or reach ``least``;
    where none reaches it, the score is any below it.
    """
    if not short or not long:
        return 0.0, 0, 0
    if least:
        shared = sum(min(short.count(c), long.count(c)) for c in set(short))
        if 200.0 * shared / (len(short) + shared) < least:
            return 0.0, 0, 0
    if len(short) > len(long):
        return indel_ratio(short, long), 0, len(long)
    at = long.find(short)
    if at >= 0:
        return 100.0, at, at + len(short)
    n, best = len(short), (0.0, 0, 0)
    need: dict[str, int] = {}
    for c in short:
        need[c] = need.get(c, 0) + 1
    spans = [(0, k) for k in range(1, n)] + [(i, i + n) for i in range(len(long) - n + 1)] + [(len(long) - k, len(long)) for k in range(n - 1, 0, -1)]
    have: dict[str, int] = {}
    shared = lo = hi = 0
    for a, b in spans:
        while hi < b:
            c = long[hi]
            have[c] = have.get(c, 0) + 1
            shared += have[c] <= need.get(c, 0)
            hi += 1
        while lo < a:
            c = long[lo]
            shared -= have[c] <= need.get(c, 0)
            have[c] -= 1
            lo += 1
        bound = 200.0 * shared / (n + b - a)
        if bound > best[0] and bound >= least:
            score = indel_ratio(short, long[a:b])
            if score > best[0]:
                best = (score, a, b)
    return best


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def said_in(value: list[str], evidence: list[str]) -> bool:
    """Is the joined value the joined text of a run of whole evidence words?"""
    target = "".join(value)
    if not target:
        return False
    edges, total = {0}, 0
    for w in evidence:
        total += len(w)
        edges.add(total)
    text, at = "".join(evidence), -1
    while (at := text.find(target, at + 1)) >= 0:
        if at in edges and at + len(target) in edges:
            return True
    return False


def check_string(value: str, evidence: str, tolerance: int = 0) -> tuple[bool, str]:
    plain, said = normalise(value)[0], normalise(evidence)[0]
    present = set(re.findall(r"\d+", said))
    for run in re.findall(r"\d+", plain):
        if run not in present:
            return False, f"evidence does not show the digits {run!r} of the value"
    mine, theirs = words_of(value), words_of(evidence)
    if said_in(mine, theirs) or (not mine and plain and plain in said):
        return True, ""
    target, text = "".join(mine), "".join(theirs)
    if tolerance and len(target) >= TOLERANT_LETTERS and text:
        _, a, b = best_window(target, text)
        edits = edit_distance(target, text[a:b])
        if edits <= tolerance:
            return True, f"value differs from the evidence by {edits} letters, which is tolerated"
    alike = best_window(*sorted((plain, said), key=len), MIN_SIMILARITY)[0]
    if alike >= MIN_SIMILARITY:
        return False, f"value is {alike:.0f}% like the evidence but differs in letters or digits"
    return False, "evidence does not show the value"


#: Answers and the signs that a label may hold.
ANSWERS = {"yes": True, "true": True, "no": False, "false": False}
LABEL_SIGNS = " ()/&,'-_"


def _answer(said: str) -> bool | None:
    """The one explicit answer of a text: it stands alone or after a label and a colon or equal
    sign, and the label holds no answer of its own."""
    said = said.removesuffix(".")
    word = next((w for w in ANSWERS if said.endswith(w)), "")
    before = said[: len(said) - len(word)].rstrip()
    if not word:
        return None
    if before:
        label = before[:-1].rstrip()
        if before[-1] not in ":=" or not label or not (label[0].isalnum() or label[0] == "_"):
            return None
        if not all(c.isalnum() or c in LABEL_SIGNS for c in label) or ANSWERS.keys() & set(re.split(r"\W+", label)):
            return None
    return ANSWERS[word]


def check_bool(value: bool, evidence: str) -> tuple[bool, str]:
    answer = _answer(normalise(evidence)[0].casefold())
    if answer is None:
        return False, "evidence does not show one explicit yes/no or true/false answer"
    return value == answer, "" if value == answer else "evidence does not show this answer"
