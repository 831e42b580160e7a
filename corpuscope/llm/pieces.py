"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from .common import resident

SPACE = "▁"
#: Stretches between spaces that a worker remembers, and the length of a remembered one.
MEMORY, LONGEST = 500_000, 48
#: Positions between two looks for a common boundary of the paths.
LOOK = 16
#: Stretches that are searched side by side, and the length of one that is searched on its own.
AT_ONCE, ALONE = 4096, 256
#: Texts cut before every space that follows another character.
STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

_U = np.uint64
_BASE, _ODD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """The pieces of a model file with their log probabilities, and the ids of the single bytes.

    ``splits`` is true if no piece has a space after another character. Then every path of the
    search meets before such a space, and the text between two of them may be remembered.
    """

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    unknown: float
    longest: int = 1
    splits: bool = False
    _young: dict[str, bytes] = field(default_factory=dict, repr=False)
    _old: dict[str, bytes] = field(default_factory=dict, repr=False)
    _table: tuple = field(default=(), repr=False)
    _pieces: dict[int, str] = field(default_factory=dict, repr=False)
    _sizes: np.ndarray | None = field(default=None, repr=False)
    _raw: dict[int, bytes] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.ids), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def __getstate__(self):
        return self.__dict__ | {"_young": {}, "_old": {}, "_table": (), "_pieces": {}, "_sizes": None, "_raw": {}}

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        """From a sentencepiece model file with byte pieces.

        A BPE file's scores are ranks. A piece of rank r gets the log probability of Zipf's law,
        -log(r + 1) up to a constant, so that the search prefers few and frequent pieces.
        """
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        bytes_ = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
        if len(bytes_) != 256:
            raise ValueError("a model with byte pieces is needed")
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
        constant = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
        scores = {model.id_to_piece(i): -math.log(r + 1) - constant for r, i in enumerate(ranked)}
        return cls({model.id_to_piece(i): i for i in plain}, scores, bytes_, min(scores.values()) - 10)

    def _ids_of(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of the best path through ``text``, in runs as soon as they are certain.

        Only the last ``longest`` places can still be extended. Their backpointers are followed
        to the boundary at which all of them meet; what lies before it is final and is handed out,
        and its backpointers are forgotten. A character without a piece costs ``unknown``. Among
        equal paths the one whose last piece is longest wins at each place.
        """
        score_of, longest = self.scores.get, self.longest
        best, back = [0.0], [0]  # of the places from ``base`` on
        base = 0
        n = len(text)
        for end in range(1, n + 1):
            top, source = -math.inf, end - 1
            for begin in range(max(0, end - longest, base), end):
                s = score_of(text[begin:end])
                if s is None:
                    if begin < end - 1:
                        continue
                    s = self.unknown
                s += best[begin - base]
                if s > top:
                    top, source = s, begin
            best.append(top)
            back.append(source)
            if end % LOOK == 0 and end < n:
                meeting = self._meeting(back, base, max(base, end - longest + 1), end)
                if meeting > base:
                    yield self._path(text, back, base, meeting)
                    del best[:meeting - base], back[:meeting - base]
                    base = meeting
        if n > base:
            yield self._path(text, back, base, n)

    @staticmethod
    def _meeting(back: list[int], base: int, low: int, high: int) -> int:
        """The boundary at which the paths of all places from ``low`` to ``high`` meet."""
        alive = set(range(low, high + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(max(back[last - base], base))
        return alive.pop()

    def _path(self, text: str, back: list[int], base: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > base:
            cuts.append(back[cuts[-1] - base])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in self._ids_of(text[a:b])]

    def _hashed(self) -> tuple:
        """Sorted hashes of the pieces with their ids and scores, and a coarse map of the hashes."""
        if not self._table:
            hashes = []
            for piece in self.ids:
                h = _U(0)
                with np.errstate(over="ignore"):
                    for c in piece:
                        h = h * _BASE + _U(ord(c) + 1)
                hashes.append(h)
            keys = np.array(hashes, np.uint64)
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
            coarse = np.zeros(1 << 20, bool)
            coarse[((keys * _ODD) >> _U(44)).astype(np.int64)] = True
            ids = np.array(list(self.ids.values()), np.int32)[order]
            scores = np.array([self.scores[p] for p in self.ids])[order]
            self._table = keys[order], ids, scores, coarse
            self._pieces = {i: p for p, i in self.ids.items()}
            self._sizes = np.zeros(max(self._pieces, default=0) + 1, np.int64)
            self._sizes[list(self._pieces)] = [len(p) for p in self._pieces.values()]
        return self._table

    def _search_many(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for many stretches, ordered by length, side by side and place by place: all ids and their number in each.

        Hashes, scores and places that can still be extended are kept for the last ``longest`` places
        only. Every ``LOOK`` places each stretch commits what lies before the boundary its paths meet
        at. A character without a piece is told as its code point, counted from -2 downwards.
        """
        keys, ids, scores, coarse = self._hashed()
        m, longest = len(stretches), self.longest
        length = np.array([len(x) for x in stretches], np.int64)
        n = int(length.max())
        codes = np.zeros((m, n), "<u4")
        codes[np.arange(n) < length[:, None]] = np.frombuffer("".join(stretches).encode("utf-32-le", "surrogatepass"), "<u4")
        codes = codes.T
        ring = longest + 1
        best = np.full((ring, m), -np.inf)
        best[0] = 0.0
        hashes = np.zeros((ring, m), np.uint64)
        low = 0  # the first place whose backpointers are kept
        last, size = [np.zeros(m, np.int64)], [np.zeros(m, np.int64)]
        base = np.zeros(m, np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def commit(upto: np.ndarray) -> None:
            """Hand out the paths between ``base`` and ``upto``."""
            width = len(last)
            path = np.full((width, m), -1, np.int64)
            place, rows = upto.copy(), np.arange(m)
            while len(rows):
                rows = rows[place[rows] > base[rows]]
                at = place[rows]
                for k in np.unique(at - low).tolist() if len(rows) < 64 else ():
                    some = rows[at - low == k]
                    path[k, some], place[some] = last[k][some], place[some] - size[k][some]
                if len(rows) >= 64:
                    k = int((at - low).max())
                    some = rows[at - low == k]
                    path[k, some], place[some] = last[k][some], place[some] - size[k][some]
            there = path.T != -1
            out.append((path.T[there], there.sum(1)))
            np.maximum(base, upto, out=base)

        def meeting(end: int) -> np.ndarray:
            """The boundary at which the paths of all places that can still be extended meet."""
            first = max(low, end - longest + 1)
            alive = np.zeros((end - low + 1, m), bool)
            alive[first - low:] = np.arange(first, end + 1)[:, None] >= base
            alive[base - low, np.arange(m)] |= ~alive.any(0)
            count = alive.sum(0)
            for place in range(end, low, -1):
                some = np.flatnonzero(alive[place - low] & (count > 1))
                if len(some):
                    alive[place - low, some] = False
                    before = np.maximum(place - size[place - low][some], base[some]) - low
                    count[some] -= alive[before, some]
                    alive[before, some] = True
            return np.where(length >= end, alive.argmax(0) + low, base)

        for end in range(1, n + 1):
            on = int(np.searchsorted(length, end))  # stretches before this one have ended
            code = codes[end - 1, on:].astype(np.uint64) + _U(1)
            top, piece = np.full(m - on, -np.inf), (-2 - codes[end - 1, on:].astype(np.int64))
            width = np.ones(m - on, np.int64)
            hashes[(end - 1) % ring, on:] = 0
            found = []
            for begin in range(max(0, end - longest), end):
                h = hashes[begin % ring, on:]
                h *= _BASE
                h += code
                maybe = np.flatnonzero(coarse[((h * _ODD) >> _U(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
                hit = keys[at] == h[maybe]
                found.append((begin, maybe[hit], at[hit]))
            for begin, who, at in found:
                s = best[begin % ring, on:][who] + scores[at]
                better = (s > top[who]) & (base[on:][who] <= begin)
                who, at = who[better], at[better]
                top[who], piece[who], width[who] = s[better], ids[at], end - begin
            alone = np.ones(m - on, bool)
            alone[found[-1][1]] = False  # those without a piece of one character
            s = best[(end - 1) % ring, on:] + self.unknown
            better = alone & (s > top)
            top[better], piece[better], width[better] = s[better], -2 - codes[end - 1, on:][better].astype(np.int64), 1
            best[end % ring, on:] = top
            row, steps = np.zeros(m, np.int64), np.zeros(m, np.int64)
            row[on:], steps[on:] = piece, width
            last.append(row)
            size.append(steps)
            done = length == end
            if done.any() or end % LOOK == 0:
                upto = base.copy()
                if end % LOOK == 0 and not done.all():
                    upto = np.maximum(upto, meeting(end))
                upto[done] = end
                commit(upto)
                keep = int(np.where(length > end, base, end).min()) - low
                if keep:
                    del last[:keep], size[:keep]
                    low += keep
        order = np.argsort(np.repeat(np.arange(len(out)), m) + np.tile(np.arange(m), len(out)) * len(out), kind="stable")
        counts = np.concatenate([c for _, c in out])
        starts = np.cumsum(counts) - counts
        flat = np.concatenate([f for f, _ in out])
        pick = np.repeat(starts[order], counts[order]) + np.arange(len(flat)) - np.repeat(np.cumsum(counts[order]) - counts[order], counts[order])
        per = counts.reshape(len(out), m).sum(0)
        return flat[pick], per

    def _fill(self, new: list[str]) -> None:
        """Search what is not remembered.

        Hashes found the pieces, so the paths are held against the texts they should spell; if one does
        not, the stretches are searched by their pieces.
        """
        several = sorted((x for x in new if len(x) <= ALONE), key=len)
        for stretch in new:
            if len(stretch) > ALONE:
                self._young[stretch] = self._one(stretch)
        for lo in range(0, len(several), AT_ONCE):
            some = several[lo:lo + AT_ONCE]
            flat, per = self._search_many(some)
            known = flat >= 0
            sizes = np.ones(len(flat), np.int64)
            sizes[known] = self._sizes[flat[known]]
            ends = np.cumsum(per)
            spelled = "".join([self._pieces[i] if i >= 0 else chr(-2 - i) for i in flat.tolist()])
            lengths = np.add.reduceat(sizes, ends - per)
            raw, ends = flat.astype("<i4").tobytes(), (4 * ends).tolist()
            if spelled == "".join(some) and lengths.tolist() == list(map(len, some)):
                self._young.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends))))
                whole = np.logical_and.reduceat(known, np.cumsum(per) - per)
                for r in np.flatnonzero(~whole).tolist():
                    self._young[some[r]] = self._with_bytes(flat[(ends[r] // 4 - per[r]):ends[r] // 4].tolist())
            else:
                self._young.update((x, self._one(x)) for x in some)

    def _one(self, stretch: str) -> bytes:
        return b"".join(np.array(run, "<i4").tobytes() for run in self.search(stretch))

    def _with_bytes(self, path: list[int]) -> bytes:
        """A path with the bytes of characters that have no piece in their place."""
        ids = [j for i in path for j in ((i,) if i >= 0 else (self.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")))]
        return np.array(ids, "<i4").tobytes()

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of whole texts; an empty one has none.

        Spaces become ``SPACE`` and one is put in front. A text that holds that character itself is
        decoded with a space in its place, as by the library. What half the memory's stretches ago was
        last met is forgotten.
        """
        lists = [self._stretches(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self._young) > MEMORY // 2:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        unmet = set().union(*lists).difference(young)
        again = unmet & old.keys()
        young.update((x, old[x]) for x in again)
        new = list(unmet - again)
        self._fill(new)
        at = young.__getitem__
        out = [np.frombuffer(b"".join(map(at, x)), "<i4") for x in lists]
        for stretch in new:
            if len(stretch) > LONGEST:
                del young[stretch]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def _stretches(self, text: str) -> list[str]:
        """The text cut before every space that follows another character, if no piece lies across.

        All paths meet at such a place, whatever follows: what lies before it can be committed.
        """
        return STRETCH.findall(text) if self.splits else [text]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        if not self._raw:
            self._raw = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
            self._raw |= {i: p.replace(SPACE, " ").encode("utf-8") for p, i in self.ids.items()}
        text = b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _vocabulary(shared) -> Vocabulary:
    key, vocabulary = shared.value
    return resident("pieces", "vocabulary", key, lambda: vocabulary)


def encode(text: Column, shared) -> Column:
    """The ids of whole texts; none for a null or empty text."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(shared)
        return pd.Series(vocabulary.encode_all(texts.fillna("").tolist()), dtype=object)

    return run(text)


def decode(ids: Column, shared) -> Column:
    """The text of ids; empty for null."""
    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(shared)
        return pd.Series([vocabulary.decode([] if x is None else x.tolist()) for x in lists], dtype=object)

    return run(ids)


def round_trip(text: Column, shared) -> Column:
    """``ids`` of whole texts as by :func:`encode` and the ``text`` they decode to as by :func:`decode`, as a struct.

    Spark would encode a text again for a decoding that is given its encoding.
    """
    @F.pandas_udf("ids array<int>, text string")
    def run(texts: pd.Series) -> pd.DataFrame:
        vocabulary = _vocabulary(shared)
        ids = vocabulary.encode_all(texts.fillna("").tolist())
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "text": [vocabulary.decode(x.tolist()) for x in ids]})

    return run(text)
