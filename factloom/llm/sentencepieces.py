"""SentencePiece encoding and decoding in batched numpy.

Texts are cut before every space mark into words, which no piece of the vocabulary crosses
(runs of marks form words of their own; see ``_split``). The distinct words of a batch are
grouped by length, and the words of a group advance together: hashes of substrings probe
the sorted hashes of the pieces, and each step is a vectorised maximum.

* Unigram models: Viterbi over the end positions; the best sum of scores and its backpointer
  are kept for every position. Sums are taken in single precision and ties go to the longer last
  piece, as the library does; where rounding alone tells two segmentations of a word apart, the
  library rounds the sum of the whole text so far and may choose the other. Words longer than ``LONG_WORD`` go alone: all their substrings are
  probed at once, then one pass over the positions follows.
* BPE models: their scores are merge ranks, for which the segmentation of largest sum is not
  what the model means. Here each round merges, in every word at once, the adjacent pair that
  forms the best piece (the leftmost of equals), until no pair forms a piece. Long words go alone
  with a heap of pairs over linked symbols.

``Model.as_unigram`` gives any vocabulary the scores of a unigram model by rule: the logarithms of
shares that fall with the rank of the piece.
"""

from __future__ import annotations

import copy
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bytesops import U64, binary_column, mix64
from factloom.llm.storage import bound_batches

MARK = "▁"
_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: Words kept with their ids between batches, at most.
KEPT_WORDS = 300_000
#: Code points beyond which a word is taken alone, in time that its length bounds nearly linearly.
LONG_WORD = 64
#: Positions of a long word whose substrings are probed together.
PROBED = 1 << 16
_MUL = 0x9E3779B97F4A7C15
#: A hash shifted by this leaves 20 bits.
_SIEVE = U64(44)
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _varint(raw: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (raw[i] & 127) << shift
        i += 1
        if raw[i - 1] < 128:
            return value, i
        shift += 7


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message: ints, or bytes for the rest."""
    i = 0
    while i < len(raw):
        tag, i = _varint(raw, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(raw, i)
        else:
            n, i = _varint(raw, i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


def _prefixes(points: np.ndarray) -> np.ndarray:
    """(rows, n + 1) running polynomial hashes of the rows of code points."""
    codes = mix64(points.astype(U64) + U64(1))
    out = np.zeros((points.shape[0], points.shape[1] + 1), U64)
    for k in range(points.shape[1]):
        out[:, k + 1] = out[:, k] * U64(_MUL) + codes[:, k]
    return out


_POWERS = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(4095, _MUL, U64))))


def _between(start: np.ndarray, stop: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of substrings of ``size`` code points from the prefixes at their ends."""
    size = np.minimum(size, len(_POWERS) - 1)
    return mix64(stop - start * _POWERS[size] + size.astype(U64))


class Model:
    """A vocabulary read from a .model file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces, self.scores, self.kinds = [], [], []
        self.kind, self.dummy_prefix, self.collapse, self.charsmap = _UNIGRAM, True, True, b""
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode("utf-8"))
                self.scores.append(float(np.frombuffer(part[2], "<f4")[0]) if 2 in part else 0.0)
                self.kinds.append(part.get(3, _NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, _UNIGRAM)
            elif number == 3:
                part = dict(_fields(value))
                self.charsmap = part.get(2, b"")
                self.dummy_prefix, self.collapse = bool(part.get(3, 1)), bool(part.get(4, 1))
        if self.charsmap or self.collapse:
            raise ValueError("only models that normalise nothing are supported")
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        usable = [i for i, k in enumerate(self.kinds) if k in (_NORMAL, _USER)]
        self.longest = max(len(self.pieces[i]) for i in usable)
        keys = np.array([self._key(self.pieces[i]) for i in usable], U64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> _SIEVE] = True
        self._score()

    def _score(self) -> None:
        self.value = np.array(self.scores, np.float32)[self.ids]
        #: What a character outside the vocabulary costs.
        self.low = np.float32(self.value.min() - np.float32(10.0))
        self._forget()

    def _forget(self) -> None:
        """Words kept with their numbers; word i has the ids from _first[i] to _first[i + 1]."""
        self.words: dict[str, int] = {}
        self._kept, self._first = np.empty(0, np.int32), np.zeros(1, np.int64)

    def as_unigram(self) -> Model:
        """The same pieces and ids under a unigram model by rule: the piece of rank r among the
        ordinary ones, in the order of their ids, has a share in proportion to 1 / r."""
        out = copy.copy(self)
        ordinary = [i for i, k in enumerate(self.kinds) if k == _NORMAL]
        total = float(np.log((1 / np.arange(1, len(ordinary) + 1)).sum()))
        out.kind, out.scores = _UNIGRAM, list(self.scores)
        for rank, i in enumerate(ordinary, 1):
            out.scores[i] = float(np.float32(-np.log(rank) - total))
        out._score()
        return out

    @staticmethod
    def _key(piece: str) -> np.uint64:
        run = _prefixes(np.array([[ord(c) for c in piece]], np.int64))
        return _between(run[:, 0], run[:, -1], np.array([len(piece)]))[0]

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Places in the sorted keys, -1 where there is none. The keys' first bits sort out most
        hashes before the search."""
        out = np.full(h.shape, -1, np.int64)
        near = self.sieve[h >> _SIEVE]
        some = h[near]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        out[near] = np.where(self.keys[at] == some, at, -1)
        return out

    def _spell(self, char: str) -> list[int]:
        raw = char.encode("utf-8")
        return [self.byte[b] for b in raw] if self.byte else [self.unknown]

    def _spelt(self, ids: list[int], chars: list[str]) -> np.ndarray:
        """Ids with the characters outside the vocabulary (-1, in their order) spelt out."""
        if -1 not in ids:
            return np.array(ids, np.int32)
        left = iter(chars)
        return np.array([x for i in ids for x in ([i] if i >= 0 else self._spell(next(left)))], np.int32)

    def _viterbi(self, points: np.ndarray) -> list[np.ndarray]:
        """The ids of words of one length, a row of code points each."""
        ids, count = self._best(points, np.full(len(points), points.shape[1]))
        return np.split(ids, np.cumsum(count)[:-1])

    def _best(self, points: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has. A row of code points is a
        word, filled up behind its end; what is computed there is not read."""
        rows, n = points.shape
        widest = min(self.longest, n)
        run = _prefixes(points)
        # at[end - 1, word]: the places of the substrings that end there, the longest first
        at = np.full((n, rows, widest), -1, np.int32)
        for size in range(1, widest + 1):
            at[size - 1 :, :, widest - size] = self.probe(_between(run[:, : n + 1 - size], run[:, size:], np.array([size]))).T
        score = np.where(at >= 0, self.value[at], np.float32(-np.inf))
        score[:, :, -1] = np.where(at[:, :, -1] >= 0, score[:, :, -1], self.low)
        best = np.full((rows, widest + n + 1), -np.inf, np.float32)  # column widest + k for position k
        best[:, widest] = 0
        size_of, piece, all_rows = np.zeros((rows, n + 1), np.int32), np.full((rows, n + 1), -1, np.int32), np.arange(rows)
        for end in range(1, n + 1):
            total = score[end - 1] + best[:, end : end + widest]
            j = total.argmax(1)
            best[:, end + widest] = total[all_rows, j]
            found = at[end - 1, all_rows, j]
            size_of[:, end] = widest - j
            piece[:, end] = np.where(found >= 0, self.ids[found], -1)
        # back from the ends, all words together; -2 where a word has begun already
        steps, stops, end = [], [], lengths.copy()
        while (end > 0).any():
            steps.append(np.where(end > 0, piece[all_rows, end], -2))
            stops.append(end.copy())
            end -= size_of[all_rows, end]
        back, stop = np.stack(steps[::-1], 1), np.stack(stops[::-1], 1)
        held = back != -2
        ids, count = back[held], held.sum(1)
        odd = np.flatnonzero(ids < 0)
        if len(odd):  # characters outside the vocabulary are spelt out
            word = np.nonzero(held)[0][odd]
            spelt = [self._spell(chr(c)) for c in points[word, stop[held][odd] - 1]]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(x) for x in spelt]
            ids = np.repeat(ids, times)
            ids[ids < 0] = [x for part in spelt for x in part]
            np.add.at(count, word, times[odd] - 1)
        return ids.astype(np.int32, copy=False), count

    def _viterbi_long(self, points: np.ndarray) -> np.ndarray:
        """The ids of one long word: its substrings of each size are probed together, then each
        position takes the best of its few candidates."""
        n, widest = len(points), self.longest
        run = np.zeros(n + 1, U64)
        codes = mix64(points.astype(U64) + U64(1))
        h = U64(0)
        mul = U64(_MUL)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = h * mul + codes[k]
                run[k + 1] = h
        best = np.full(widest + n + 1, -np.inf, np.float32)  # place widest + k for position k
        best[widest] = 0
        size_of, piece = np.ones(n + 1, np.int64), np.full(n + 1, -1, np.int64)
        sizes = np.arange(widest, 0, -1)
        for first in range(1, n + 1, PROBED):
            ends = np.arange(first, min(n + 1, first + PROBED))
            start = ends[:, None] - sizes[None, :]
            held = start >= 0
            at = np.where(held, self.probe(_between(run[np.maximum(start, 0)], run[ends][:, None], np.broadcast_to(sizes, start.shape))), -1)
            score = np.where(at >= 0, self.value[at], np.float32(-np.inf))
            score[:, -1] = np.where(at[:, -1] >= 0, score[:, -1], self.low)
            chosen = np.empty(len(ends), np.int64)
            for k, end in enumerate(ends.tolist()):
                total = score[k] + best[end : end + widest]
                j = chosen[k] = total.argmax()
                best[end + widest] = total[j]
            size_of[ends] = sizes[chosen]
            found = at[np.arange(len(ends)), chosen]
            piece[ends] = np.where(found >= 0, self.ids[found], -1)
        ids, odd, end = [], [], n
        while end:
            ids.append(int(piece[end]))
            if ids[-1] < 0:
                odd.append(chr(points[end - 1]))
            end -= int(size_of[end])
        return self._spelt(ids[::-1], odd[::-1])

    def _merge_long(self, word: str) -> np.ndarray:
        """The ids of one long word under a BPE model: a heap of pairs over linked symbols. A pair
        that a neighbour's merge has changed is passed over when its turn comes."""
        if not hasattr(self, "_rank"):
            self._rank = {self.pieces[i]: (-float(v), int(i)) for i, v in zip(self.ids, self.value, strict=True)}
        rank, n = self._rank, len(word)
        stop, before = list(range(1, n + 1)), list(range(-1, n))  # of the symbol that starts here
        heap = [(x[0], a, a + 2) for a in range(n - 1) if (x := rank.get(word[a : a + 2]))]
        heapq.heapify(heap)
        while heap:
            _, a, end = heapq.heappop(heap)
            middle = stop[a]
            if middle < 0 or middle >= n or stop[middle] != end:
                continue
            stop[a], stop[middle] = end, -1
            if end < n:
                before[end] = a
                if x := rank.get(word[a : stop[end]]):
                    heapq.heappush(heap, (x[0], a, stop[end]))
            b = before[a]
            if b >= 0 and (x := rank.get(word[b:end])):
                heapq.heappush(heap, (x[0], b, end))
        ids, odd, a = [], [], 0
        while a < n:
            x = rank.get(word[a : stop[a]])
            ids.append(x[1] if x else -1)
            if not x:
                odd.append(word[a : stop[a]])
            a = stop[a]
        return self._spelt(ids, odd)

    def _merges(self, points: np.ndarray) -> list[np.ndarray]:
        rows, n = points.shape
        # begin[i, k]: where symbol k of word i starts; the symbols end at `count`
        begin = np.tile(np.arange(n + 1), (rows, 1))
        count = np.full(rows, n)
        live = np.arange(rows) if n > 1 else np.empty(0, np.int64)
        run = _prefixes(points)
        pair = self._pairs(run, begin, np.repeat(np.arange(rows), max(0, n - 1)), np.tile(np.arange(max(0, n - 1)), rows)).reshape(rows, max(0, n - 1))
        while len(live):
            k = pair[live].argmax(1)
            top = pair[live, k]
            live, k = live[top > -np.inf], k[top > -np.inf]
            if not len(live):
                break
            # drop the boundary k + 1 of each word
            width = begin.shape[1]
            cols = np.arange(width - 1)
            source = cols[None, :] + (cols[None, :] >= (k + 1)[:, None])
            begin[live, :-1] = np.take_along_axis(begin[live], source, 1)
            source = np.minimum(np.arange(pair.shape[1])[None, :] + (np.arange(pair.shape[1])[None, :] >= k[:, None]), pair.shape[1] - 1)
            pair[live] = np.take_along_axis(pair[live], source, 1)
            count[live] -= 1
            pair[live, np.maximum(count[live] - 1, 0)] = -np.inf
            for d in (-1, 0):  # the new symbol with its neighbours
                at = k + d
                ok = (at >= 0) & (at + 1 < count[live])
                pair[live[ok], at[ok]] = self._pairs(run, begin, live[ok], at[ok])
            live = live[count[live] > 1]
        # the ids of all symbols at once; those outside the vocabulary are single characters
        edge = np.concatenate([begin, np.full((rows, 1), n)], 1)
        edge[np.arange(rows), count] = n
        word, k = np.nonzero(np.arange(n)[None, :] < count[:, None])
        first, last = edge[word, k], edge[word, k + 1]
        at = self.probe(_between(run[word, first], run[word, last], last - first))
        ids = np.where(at >= 0, self.ids[at], -1).astype(np.int32)
        out = np.split(ids, np.cumsum(count)[:-1])
        for i in np.unique(word[ids < 0]):
            lo = int(count[:i].sum())
            cut = [*first[lo : lo + count[i]].tolist(), n]
            spelt = [[int(x)] if x >= 0 else self._spell("".join(map(chr, points[i, u:v]))) for x, u, v in zip(out[i], cut[:-1], cut[1:], strict=True)]
            out[i] = np.array([x for part in spelt for x in part], np.int32)
        return out

    def _pairs(self, run: np.ndarray, begin: np.ndarray, word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Scores of the pieces that symbols k and k + 1 of the words form, -inf for none."""
        a, b = begin[word, k], begin[word, np.minimum(k + 2, begin.shape[1] - 1)]
        at = self.probe(_between(run[word, a], run[word, b], b - a))
        return np.where((at >= 0) & (b - a <= self.longest), self.value[at], -np.inf)

    def _split(self, text: str) -> list[str]:
        """Words: cut before a mark that follows another character and after runs of marks
        that another mark's word doesn't continue."""
        return _WORD.findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, those of the library's encode."""
        split = []
        for text in texts:
            text = text.replace(" ", MARK)
            split.append(self._split((MARK if self.dummy_prefix and text else "") + text))
        if len(self.words) > KEPT_WORDS:
            self._forget()
        self._learn(set().union(*split) - self.words.keys())
        out = []
        for words in split:
            which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            first = self._first[which]
            size = self._first[which + 1] - first
            before = np.cumsum(size) - size
            out.append(self._kept[np.repeat(first - before, size) + np.arange(size.sum())])
        return out

    def _learn(self, new: set[str]) -> None:
        """Keep the words with their ids. Words of one length go together under a BPE model, those
        of a range of lengths under a unigram model, in parts that bound the memory."""
        learnt, found, counts = [], [self._kept], [np.empty(0, np.int64)]
        groups: dict[int, list[str]] = {}
        for w in new:
            n = len(w)
            if n > LONG_WORD:
                learnt.append(w)
                found.append(self._merge_long(w) if self.kind == _BPE else self._viterbi_long(np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64)))
                counts.append(np.array([len(found[-1])]))
            else:
                groups.setdefault(n if self.kind == _BPE else -(-n // 4) * 4, []).append(w)
        for widest, words in groups.items():
            step = max(1, 200_000 // widest)
            for i in range(0, len(words), step):
                part = words[i : i + step]
                raw = "".join([w.ljust(widest, "\0") for w in part]).encode("utf-32-le")
                points = np.frombuffer(raw, np.uint32).reshape(len(part), widest).astype(np.int64)
                if self.kind == _BPE:
                    ids = self._merges(points)
                    found += ids
                    counts.append(np.array([len(x) for x in ids]))
                else:
                    ids, count = self._best(points, np.array([len(w) for w in part]))
                    found.append(ids)
                    counts.append(count)
                learnt += part
        self.words.update(zip(learnt, range(len(self.words), len(self.words) + len(learnt)), strict=True))
        self._kept = np.concatenate(found)
        self._first = np.concatenate([self._first, self._first[-1] + np.cumsum(np.concatenate(counts))])

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of id sequences; byte pieces are joined before they are read as UTF-8."""
        if not hasattr(self, "_bytes"):
            back = {i: b for b, i in self.byte.items()}
            self._bytes = [bytes([back[i]]) if i in back else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.replace(MARK, " ").encode("utf-8") for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        out = []
        for seq in ids:
            text = b"".join([self._bytes[i] for i in seq.tolist()]).decode("utf-8", "replace")
            out.append(text[1:] if self.dummy_prefix and text.startswith(" ") else text)
        return out


_MODELS: dict[tuple[str, bool], Model] = {}


def load(path: str, unigram: bool = False) -> Model:
    """The model of a file, or its vocabulary as a unigram model; a worker reads it once."""
    if (path, unigram) not in _MODELS:
        _MODELS[path, unigram] = Model(path).as_unigram() if unigram else Model(path)
    return _MODELS[path, unigram]


def encode(docs: DataFrame, model_path: str, unigram: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id and ids (array of int).

    Needs doc_id (long) and text; other columns are ignored. Null texts give null, empty texts
    empty arrays; repeated rows are encoded alike. Whole texts are encoded, words of any length
    too. ``unigram`` takes the model's vocabulary as a unigram model. Models with a character map
    or that drop extra white space are refused.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, unigram)
        for batch in batches:
            raw = binary_column(batch, "text")
            ids = model.encode([(t or b"").decode("utf-8") for t in raw])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([None if t is None else i for t, i in zip(raw, ids, strict=True)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id and text, null for null ids."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            text = model.decode([np.array(i or [], np.int64) for i in ids])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([None if i is None else t for i, t in zip(ids, text, strict=True)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, unigram: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_ids, ids_crc32 (little-endian 32-bit), n_bytes
    and decoded_crc32 of the decoded text's UTF-8. Null texts count as empty."""
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64()), ("decoded_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path, unigram)
        for batch in batches:
            texts = [(t or b"").decode("utf-8") for t in binary_column(batch, "text")]
            ids = model.encode(texts)
            back = [t.encode("utf-8") for t in model.decode(ids)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array([len(t) for t in back], pa.int64()), pa.array([zlib.crc32(t) for t in back], pa.int64())], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, decoded_crc32 long")
