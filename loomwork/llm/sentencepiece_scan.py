"""SentencePiece encoding and decoding: BPE merges, and a max-plus parallel scan for unigram models.

``tokenized`` encodes by the method the model file names. The scores of a BPE file are merge ranks,
so its texts are encoded by merges: the library encodes each distinct stretch between forced cuts
(places that no piece spans), and a giant text is split into chunks anywhere, whose max-plus
matrices weigh neighbouring pieces by whether merging leaves them as they are (``_merged_giants``).

For a unigram model (and in ``encode`` and ``encode_ids``, whatever the file) a text is encoded as the best-scoring chain of vocabulary pieces (Viterbi over the scores that the
model file gives; scores are whole numbers, so sums are exact in any order). Characters outside the
vocabulary fall back to byte pieces. A position where a space mark follows another character is a
forced cut when, as here, no piece holds a mark after another character: words between cuts are
encoded once a worker and remembered.

A giant text is split into chunks. What a chunk does to the best scores at the last ``reach``
positions before it is a max-plus matrix; matrices are made independently, combined associatively
(a scan within a text gives each chunk its entry scores), chunks then find in parallel which entry
each exit leads back to, those small maps are composed from the end, and each chunk is traced back
on its own.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.scratch import parts, stored
from loomwork.llm.textnp import mix, slices

GIANT, CHUNK = 65_536, 16_384
"""Characters beyond which a text is split, and characters of a chunk."""
BLOCK = 64
"""Chunks whose matrices are multiplied together."""
MEMO_WORDS = 300_000
FEW = 16
"""Stretches below which each goes to the library by itself."""
SENT = 512
"""Chunks of a batch."""
MARK, OWN_MARK = "▁", "\ud800"
"""The space mark; and what stands for that character in a text itself (no text can hold a lone surrogate)."""
NEVER = -(1 << 60)
_B, _B_INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BPE = 2
UNKNOWN = 10
"""An unknown character costs so much more than the worst piece."""


def marked(text: str) -> str:
    return MARK + text.replace(MARK, OWN_MARK).replace(" ", MARK) if text else ""


def model_type(path: str) -> int:
    """The ``trainer_spec.model_type`` of a model file: 1 unigram, 2 BPE, 3 word, 4 char."""
    with open(path, "rb") as file:
        data = file.read()

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    def fields(at: int, end: int) -> Iterator[tuple[int, int, int]]:
        while at < end:
            tag, at = number(at)
            if tag & 7 == 0:
                value, to = number(at)
            elif tag & 7 == 2:
                value, at = number(at)
                to = at + value
            else:
                value, to = 0, at + (4 if tag & 7 == 5 else 8)
            yield tag, value if tag & 7 == 0 else at, to
            at = to

    found = 1
    for tag, body, to in fields(0, len(data)):
        if tag == 2 << 3 | 2:
            found = next((value for t, value, _ in fields(body, to) if t == 3 << 3), found)
    return found


class Merges:
    """The library's BPE ids of marked texts, by stretches between forced cuts.

    The library puts a mark before what it is given: a stretch that starts with a mark goes without
    it, any other after a character that no piece holds, whose ids are then dropped. A mark of the
    text itself would become a space there; it takes its byte pieces instead, so texts come back.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        held = set("".join(pieces))
        self.alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in held)
        self.cuts = bool(self.alone) and not any(MARK in p.lstrip(MARK) for p in pieces)
        alone = re.escape(self.alone) + OWN_MARK
        self.stretch = re.compile(f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if self.cuts else f"{OWN_MARK}|[^{OWN_MARK}]+")
        self.own = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in MARK.encode()], "<u4").tobytes()
        self.lone = np.array([model.piece_to_id(MARK)], "<u4").tobytes()
        self.lead = (self.alone or "\n")[:1]
        self.led = len(model.encode(self.lead))
        self.memo: dict[str, bytes] = {}
        self.unit_ids: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        out = {w: self.own if w == OWN_MARK else self.lone for w in words if w in (OWN_MARK, MARK)}
        some = [w for w in words if w not in out]
        given = [(w[1:] if w[0] == MARK else self.lead + w).replace(MARK, " ") for w in some]
        # a list costs the library a pool of threads a call
        made = [self.model.encode(w) for w in given] if len(given) < FEW else self.model.encode(given, num_threads=1)
        for w, ids in zip(some, made):
            out[w] = array("I", ids if w[0] == MARK else ids[self.led :]).tobytes()
        return out

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """Ids of each marked text as bytes of 32-bit numbers; stretches new to the worker go to the library together."""
        parts = [self.stretch.findall(x) for x in texts]
        words: set[str] = set()
        words.update(*parts)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = self.learn([w for w in words if w not in self.memo])
        self.memo.update((w, ids) for w, ids in new.items() if len(w) <= 48)
        known = self.memo if all(len(w) <= 48 for w in new) else self.memo | new
        return [b"".join([known[w] for w in p]) for p in parts]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.encode_marked([marked(t) for t in texts])

    @cached_property
    def units(self) -> set[str]:
        return {self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))}

    @cached_property
    def reach(self) -> int:
        return max(map(len, self.units))

    @cached_property
    def cut(self) -> re.Pattern:
        alone = re.escape(self.alone) + OWN_MARK
        return re.compile(f"(?<=[^{MARK}])(?={MARK})|(?<=[{alone}])|(?=[{alone}])" if self.cuts else f"(?<={OWN_MARK})|(?={OWN_MARK})")

    def is_cut(self, x: str, at: int) -> bool:
        return at == 0 or bool(self.cut.match(x, at))

    def ids_of(self, unit: str) -> bytes:
        """Ids of a piece, or of a character outside the vocabulary."""
        if unit not in self.unit_ids:
            known = unit in self.units and unit != OWN_MARK
            self.unit_ids[unit] = np.array([self.model.piece_to_id(unit)], "<u4").tobytes() if known else self.encode_marked([unit])[0]
        return self.unit_ids[unit]

    def fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: merging the two together leaves just these two. An empty a stands for a forced cut."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 4 * MEMO_WORDS:
                self.pairs.clear()
            known = self.pairs[key] = self.encode_marked([a + b])[0] == (self.ids_of(a) if a else b"") + self.ids_of(b)
        return known

    def states(self, x: str, at: int, last: bool) -> list[tuple[int, str]]:
        """What a chain may look like at a boundary: (place, piece that ends there), back to a forced cut, which is one state."""
        units, cut, low = self.units, self.cut.match, max(-1, at - self.reach)
        end = next((p for p in range(at, low, -1) if not p or cut(x, p) or last and p == len(x)), None)
        # no piece spans a forced cut
        out = [(p, x[i:p]) for p in range(at, low if end is None else end, -1) for i in range(p - 1, max(end or 0, p - self.reach) - 1, -1) if i == p - 1 or x[i:p] in units]
        return out if end is None else [*out, (end, "")]

    def reached(self, x: str, seeds: dict[tuple[int, str], int], start: int, to: int) -> dict[int, dict[str, int]]:
        """For each place from the first seed up to ``to``, the pieces that end there on a chain from a seed, with the set of its seeds as bits."""
        low = min(p for p, _ in seeds)
        at: dict[int, dict[str, int]] = {p: {} for p in range(low, to + 1)}
        for (p, piece), bit in seeds.items():
            at[p][piece] = bit
        for j in range(start + 1, to + 1):
            here = at[j]
            for i in range(max(low, j - self.reach), j):
                before = at[i]
                if before and (i == j - 1 or x[i:j] in self.units):
                    t = x[i:j]
                    bits = 0
                    for a, m in before.items():
                        if self.fits(a, t):
                            bits |= m
                    if bits:
                        here[t] = bits
        return at

    def around(self, x: str, at: int, end: int, last: bool) -> tuple[int, int] | None:
        """The first and the last forced cut from ``at`` to ``end``."""
        first = at if self.is_cut(x, at) else next((m.start() for m in self.cut.finditer(x, at)), end + 1)
        if first > end:
            return (end, end) if last else None
        if last:
            return first, end
        return first, next((c for c in range(end, first, -1) if self.cut.match(x, c)), first)

    def matrix(self, x: str, at: int, last: bool) -> np.ndarray:
        """Of a chunk x[at:], with one character more unless it is the text's last: [entry, exit] is 0 where a chain leads from the entry state to the exit state else NEVER (a max-plus matrix)."""
        end = len(x) - (not last)
        entry, out = self.states(x, at, False), self.states(x, end, last)
        m = np.full((len(entry), len(out)), NEVER)
        cuts = self.around(x, at, end, last)
        seeds = {s: 1 << k for k, s in enumerate(entry)}
        if cuts is None:
            got = self.reached(x, seeds, at, end)
            bits = [got.get(p, {}).get(piece, 0) for p, piece in out]
        else:
            head = self.reached(x, seeds, at, cuts[0])[cuts[0]]
            alive = 0
            for v in head.values():
                alive |= v
            tail = self.reached(x, {(cuts[1], ""): 1}, cuts[1], end)
            bits = [alive if (p == cuts[1] and not piece) or (p >= cuts[1] and tail[p].get(piece)) else 0 for p, piece in out]
        for f, b in enumerate(bits):
            while b:
                m[(b & -b).bit_length() - 1, f] = 0
                b &= b - 1
        return m

    def back(self, x: str, at: dict[int, dict[str, int]], end: int, piece: str, start: int) -> list[str]:
        """The pieces of the chain that ends with ``piece`` at ``end``, back to what ends at ``start`` or before."""
        out = []
        while end > start and piece:
            out.append(piece)
            end -= len(piece)
            if end > start:
                piece = next(a for a in at[end] if self.fits(a, piece))
        return out[::-1]

    def part(self, x: str, at: int, last: bool, entry: int, leave: int) -> bytes:
        before, between, after = self.parted(x, at, last, entry, leave)
        return before + self.encode_marked([between])[0] + after

    def parted(self, x: str, at: int, last: bool, entry: int, leave: int) -> tuple[bytes, str, bytes]:
        """Ids of the pieces after the entry state up to the exit state, traced back within the chunk; what lies between forced cuts is returned as text."""
        p, piece = self.states(x, at, False)[entry]
        end = len(x) - (not last)
        q, final = self.states(x, end, last)[leave]
        cuts = self.around(x, at, end, last)
        if cuts is None:
            got = self.reached(x, {(p, piece): 1}, at, end)
            return b"".join(map(self.ids_of, self.back(x, got, q, final, p))), "", b""
        head = self.reached(x, {(p, piece): 1}, at, cuts[0])
        first = self.back(x, head, cuts[0], next(iter(head[cuts[0]])), p) if cuts[0] > p else []
        tail = self.back(x, self.reached(x, {(cuts[1], ""): 1}, cuts[1], end), q, final, cuts[1])
        return b"".join(map(self.ids_of, first)), x[cuts[0] : cuts[1]], b"".join(map(self.ids_of, tail))


class Lattice:
    def __init__(self, path: str):
        import sentencepiece

        self.path = path
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, int] = {}
        self.ids: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.score[piece], self.ids[piece] = int(model.get_score(i)), i
                self.raw.append(piece.replace(MARK, " ").encode())
        self.reach = max(map(len, self.score))
        self.unknown = min(s for s in self.score.values() if s > -(10**8)) - UNKNOWN
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.score)
        held = set("".join(self.score))
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if c not in held)
        self.stretch = re.compile(f"[{re.escape(alone)}]|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.memo: dict[str, tuple[int, bytes]] = {}
        pieces = list(self.score)
        keys = np.array([self._keys(np.frombuffer(p.encode("utf-32-le"), "<u4"))[0][-1] for p in pieces])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_score = np.array([self.score[p] for p in pieces], np.int64)[order]
        self.key_id = np.array([self.ids[p] for p in pieces], np.int32)[order]
        self.near = np.zeros(1 << 18, bool)
        self.near[(mix(self.keys) >> np.uint64(46)).astype(np.int64)] = True

    @staticmethod
    def _keys(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of ``(c + 1) * B**place`` before each place, and what brings the sum of a stretch to place 0."""
        power, back = np.full(len(points) + 1, _B, np.uint64), np.full(len(points) + 1, _B_INVERSE, np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
        return sums, back

    def learn(self, words: list[str]) -> None:
        """Encode many stretches at once and remember them: the Viterbi runs of all words go position by position together.

        Words that are long or hold characters outside the vocabulary take the plain run.
        """
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        at = 0
        while at < len(words):
            some, size = [], 0
            while at < len(words) and size < 150_000:
                if len(words[at]) <= 48:
                    some.append(words[at])
                    size += len(words[at])
                else:
                    self.word(words[at])
                at += 1
            self._learn(some)

    def _learn(self, words: list[str]) -> None:
        if not words:
            return
        words.sort(key=len, reverse=True)
        size = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        sums, back = self._keys(points)
        start = np.cumsum(size) - size
        place = np.arange(len(points)) - np.repeat(start, size) + 1  # of each character, as an end
        score = np.full((self.reach + 1, len(points)), NEVER)
        ident = np.zeros((self.reach + 1, len(points)), np.int32)
        for n in range(1, self.reach + 1):
            end = np.flatnonzero(place >= n)
            key = (sums[end + 1] - sums[end + 1 - n]) * back[end + 1 - n]
            maybe = np.flatnonzero(self.near[(mix(key) >> np.uint64(46)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
            hit = self.keys[k] == key[maybe]
            score[n, end[maybe[hit]]], ident[n, end[maybe[hit]]] = self.key_score[k[hit]], self.key_id[k[hit]]
        node = start + np.arange(len(words))  # each word has one node more than characters
        best, step = np.full(len(points) + len(words), NEVER), np.zeros(len(points) + len(words), np.int8)
        best[node] = 0
        active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "right")  # words of at least that length
        for p in range(1, int(size[0]) + 1):
            m = active[p]
            here, char = node[:m] + p, start[:m] + p - 1
            top, by = np.full(m, NEVER), np.zeros(m, np.int8)
            for n in range(min(p, self.reach), 0, -1):
                value = best[here - n] + score[n, char]
                better = value > top
                top[better], by[better] = value[better], n
            best[here], step[here] = np.maximum(top, NEVER), by
        known = best[node + size] > NEVER // 2
        cur, live, found = size.copy(), np.flatnonzero(known & (size > 0)), []
        while len(live):
            n = step[node[live] + cur[live]].astype(np.int64)
            found.append((live, ident[n, start[live] + cur[live] - 1]))
            cur[live] -= n
            live = live[cur[live] > 0]
        owner = np.concatenate([f[0] for f in found[::-1]]) if found else np.zeros(0, np.int64)
        ids = np.concatenate([f[1] for f in found[::-1]]).astype("<u4") if found else np.zeros(0, "<u4")
        packed = ids[np.argsort(owner, kind="stable")].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        totals, known = best[node + size].tolist(), known.tolist()
        a = 0
        for k, w in enumerate(words):
            if known[k]:
                self.memo[w] = (totals[k], packed[a : ends[k]])
            else:
                self.word(w)
            a = ends[k]

    def edges(self, x: str, j: int, low: int) -> Iterator[tuple[int, int]]:
        """(start, score) of the pieces of x that end at j and start at ``low`` or later, the longest first."""
        for i in range(max(low, j - self.reach), j):
            s = self.score.get(x[i:j])
            if s is None and i == j - 1:
                s = self.unknown
            if s is not None:
                yield i, s

    def run(self, x: str, at: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Best score at each position of x and the start of the piece that gives it (the longest on ties).

        ``entry`` has the scores of positions at, at - 1, ...; positions after ``at`` are computed.
        """
        best, back = [NEVER] * (len(x) + 1), [-1] * (len(x) + 1)
        for s, v in enumerate(entry):
            if at - s >= 0:
                best[at - s] = v
        for j in range(at + 1, len(x) + 1):
            top, start = NEVER, -1
            for i, s in self.edges(x, j, 0):
                if best[i] > NEVER // 2 and best[i] + s > top:
                    top, start = best[i] + s, i
            best[j], back[j] = top, start
        return best, back

    def piece_ids(self, x: str, i: int, j: int) -> list[int]:
        known = self.ids.get(x[i:j])
        return [known] if known is not None else [self.byte_id[b] for b in (MARK if x[i:j] == OWN_MARK else x[i:j]).encode()]

    def trace(self, x: str, back: list[int], end: int, at: int) -> tuple[list[int], int]:
        """Ids from the piece that starts at or before ``at`` up to ``end``, and where the first starts."""
        parts = []
        while end > at:
            parts.append(self.piece_ids(x, back[end], end))
            end = back[end]
        return [i for p in reversed(parts) for i in p], end

    def word(self, x: str) -> tuple[int, bytes]:
        """Score and ids (as bytes of 32-bit numbers) of a stretch between cuts."""
        got = self.memo.get(x)
        if got is None:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            best, back = self.run(x, 0, [0])
            ids, _ = self.trace(x, back, len(x), 0)
            got = self.memo[x] = (best[-1], np.array(ids, "<u4").tobytes())
        return got

    def stretches(self, x: str) -> list[str]:
        return self.stretch.findall(x) if self.cuts else [x] if x else []

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit numbers; words new to the worker are learnt together."""
        parts = [self.stretches(marked(t)) for t in texts]
        new: set[str] = set()
        new.update(*parts)
        self.learn([w for w in new if w not in self.memo])
        memo = self.memo
        if all(w in memo for w in new):
            return [b"".join([memo[w][1] for w in p]) for p in parts]
        return [b"".join([self.word(w)[1] for w in p]) for p in parts]

    def encode(self, text: str) -> bytes:
        """Ids by the model's own method: merges where it is a BPE model, else the best chain."""
        return (merges(self.path) or self).encode_all([text])[0]

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        """The text's UTF-8 bytes."""
        raw = self.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:]

    def splits(self, x: str, at: int) -> tuple[int, int] | None:
        """The first cut after ``at`` and the last one from which every later exit position can be reached."""
        if not self.cuts:
            return None
        first = _CUT.search(x, at)
        if not first:
            return None
        last = max((m.start() + 1 for m in _CUT.finditer(x, max(first.start(), len(x) - self.reach - 4096)) if m.start() + 1 <= len(x) - self.reach + 1), default=first.start() + 1)
        return (first.start() + 1, last) if first.start() + 1 <= len(x) - self.reach + 1 else None

    def matrix(self, x: str, at: int) -> np.ndarray:
        """[entry, exit]: best score from position at - entry to position len(x) - exit, through x[at:]."""
        n, cut = self.reach, self.splits(x, at)
        first, last = cut or (len(x), len(x))
        best = np.full((len(x) + 1, n), NEVER)
        for s in range(min(n, at + 1)):
            best[at - s, s] = 0
        for j in range(at + 1, first + 1):
            for i, score in self.edges(x, j, max(0, at - n + 1)):
                np.maximum(best[j], best[i] + score, out=best[j])
        if cut:
            middle = sum(self.word(w)[0] for w in self.stretches(x[first:last]))
            rest, _ = self.run(x[last:], 0, [0])
            for k, v in enumerate(rest):
                best[last + k] = best[first] + middle + v if v > NEVER // 2 else NEVER
        out = np.full((n, n), NEVER)
        for s in range(min(n, len(x) + 1)):
            out[:, s] = best[len(x) - s]
        return np.maximum(out, NEVER)


_CUT = re.compile(f"[^{MARK}](?={MARK})")


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


@lru_cache(2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


@lru_cache(2)
def merges(path: str) -> Merges | None:
    return Merges(path) if model_type(path) == BPE else None


def _row(digest: str, ids: bytes, n_bytes: int, ok: bool) -> tuple:
    return digest, n_bytes, len(ids) // 4, hashlib.sha256(ids).hexdigest(), ok


_RESULT = "n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean"


def _results(rows: list[tuple], key: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[key, "n_bytes", "n_pieces", "ids_sha256", "round_trip"])


def _plain(path: str, chains: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        method = model if chains else merges(path) or model
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows = []
                for key, text, ids in zip(part.column(0).to_pylist(), texts, method.encode_all(texts)):
                    raw = text.encode()
                    rows.append(_row(key, ids, len(raw), model.decode(ids) == raw))
                yield _results(rows, batch.schema.names[0], batch.schema.types[0])

    return run


def encode_ids(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of the best chain of every document row; a null or empty text has none. For texts that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            ids = [np.frombuffer(model.encode_all([t or ""])[0], "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids; null ids are an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path)
        for batch in batches:
            texts = [model.decode(np.array(x or [], "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _whole(path: str, rows: list[dict]) -> pa.RecordBatch:
    """The results of a text from the ids of its chunks, in order."""
    ids = b"".join(r["ids"] for r in rows)
    raw = lattice(path).decode(ids)
    return _results([_row(rows[0]["digest"], ids, len(raw), hashlib.sha256(raw).hexdigest() == rows[0]["digest"])], "digest", pa.string())


def _gather(path: str):
    def gather(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_whole(path, sorted(table.to_pylist(), key=lambda r: r["k"]))])

    return gather


def _grouped(rows: DataFrame, n: int, keys: list[str], order: str, step: Callable[[list[dict]], pa.RecordBatch], schema: str) -> DataFrame:
    """``step`` of the rows of each group, in order. As ``applyInArrow``, without its cost a group: most groups are a few small rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                key = tuple(r[k] for k in keys)
                if held and key != group:
                    out.append(step(held))
                    held = []
                group = key
                held.append(r)
            if out:
                yield pa.concat_batches(out)
                out = []
        if held:
            yield step(held)

    return rows.repartition(n, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def threaded(matrices: list[np.ndarray], first: np.ndarray, leave: int) -> list[tuple[int, int]]:
    """Entry and exit state of each of a row of chunks: entry scores forward, then the one way that leads to ``leave`` back."""
    scores, out = [first], []
    for m in matrices[:-1]:
        scores.append(combined(scores[-1], m))
    for v, m in zip(reversed(scores), reversed(matrices)):
        entry = int(np.argmax(v[0] + m[:, leave]))
        out.append((entry, leave))
        leave = entry
    return out[::-1]


def _only(n: int, at: int) -> np.ndarray:
    out = np.full((1, n), NEVER)
    out[0, at] = 0
    return out


def _merged_giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """digest and results of distinct giant texts by BPE merges, as a max-plus scan over chunks.

    A chain of pieces is what merging gives if and only if each two neighbours stay as they are when
    merged on their own. So pairs that fit weigh 0 and others never, a boundary's states are the pieces
    that may end about it, and a chunk is a max-plus matrix between the states of its two boundaries.
    Blocks of chunks multiply their matrices, the blocks' products give each block its entry and exit
    state, those give each chunk its own, and every chunk is traced back by itself.
    """
    n = parts(texts.sparkSession)
    sent = max(1, min(SENT, (1 << 20) // chunk))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = merges(path).reach
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                x = marked(text)
                n_chunks = -(-len(x) // chunk)
                for b in range(0, n_chunks, sent):
                    k = range(b, min(b + sent, n_chunks))
                    low = [max(0, i * chunk - 2 * reach) for i in k]
                    body = [x[a : (i + 1) * chunk + 1].encode("utf-8", "surrogatepass") for i, a in zip(k, low)]
                    at = [i * chunk - a for i, a in zip(k, low)]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(k)), pa.array(k, pa.int32()), pa.array([i // BLOCK for i in k], pa.int32()), pa.array(at, pa.int32()), pa.array([(i + 1) * chunk >= len(x) for i in k]), pa.array(body, pa.binary())], names=["digest", "k", "block", "at", "last", "body"])

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [merges(path).matrix(b.decode("utf-8", "surrogatepass"), at, last) for b, at, last in zip(batch.column("body").to_pylist(), batch.column("at").to_pylist(), batch.column("last").to_pylist())]
            yield _matrices([*batch.select(["digest", "k", "block"]).columns], made, ["digest", "k", "block"])

    def product(rows: list[dict]) -> pa.RecordBatch:
        whole = _matrix(rows[0])
        for r in rows[1:]:
            whole = combined(whole, _matrix(r))
        return _matrices([pa.array([rows[0]["digest"]]), pa.array([rows[0]["block"]], pa.int32())], [whole], ["digest", "block"])

    def blocks(rows: list[dict]) -> pa.RecordBatch:
        matrices = [_matrix(r) for r in rows]
        ways = threaded(matrices, _only(len(matrices[0]), 0), 0)
        return pa.RecordBatch.from_arrays([pa.array([r["digest"] for r in rows]), pa.array([r["block"] for r in rows], pa.int32()), *(pa.array([w[i] for w in ways], pa.int32()) for i in (0, 1))], names=["digest", "block", "entry", "leave"])

    def within(rows: list[dict]) -> pa.RecordBatch:
        matrices = [_matrix(r) for r in rows]
        ways = threaded(matrices, _only(len(matrices[0]), rows[0]["entry"]), rows[0]["leave"])
        return pa.RecordBatch.from_arrays([pa.array([r["digest"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()), *(pa.array([w[i] for w in ways], pa.int32()) for i in (0, 1))], names=["digest", "k", "entry", "leave"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, sent):
                some = batch.slice(at, sent)
                made = [merges(path).parted(r["body"].decode("utf-8", "surrogatepass"), r["at"], r["last"], r["entry"], r["leave"]) for r in some.to_pylist()]
                middle = merges(path).encode_marked([m for _, m, _ in made])
                ids = [a + b + c for (a, _, c), b in zip(made, middle)]
                yield pa.RecordBatch.from_arrays([some.column("digest"), some.column("k"), pa.array(ids, pa.binary())], names=["digest", "k", "ids"])

    chunks = stored(texts.mapInArrow(split, "digest string, k int, block int, at int, last boolean, body binary").repartition(n, "digest", "k"), "chunks")
    made = stored(chunks.repartition(n, "digest", "k").mapInArrow(transfer, "digest string, k int, block int, wide int, m binary"), "matrices")
    products = _grouped(made, n, ["digest", "block"], "k", product, "digest string, block int, wide int, m binary")
    ways = _grouped(products, n, ["digest"], "block", blocks, "digest string, block int, entry int, leave int")
    # dealt out by number: tasks that hold few bytes and much work are not to be put together
    led = made.repartition(n, "digest", "block").join(ways.repartition(n, "digest", "block"), ["digest", "block"])
    each = _grouped(led, n, ["digest", "block"], "k", within, "digest string, k int, entry int, leave int")
    ids = chunks.repartition(n, "digest", "k").join(each.repartition(n, "digest", "k"), ["digest", "k"]).mapInArrow(emit, "digest string, k int, ids binary")
    return _grouped(ids, n, ["digest"], "k", partial(_whole, path), f"digest string, {_RESULT}")


def _matrices(columns: list[pa.Array], made: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    wide = pa.array([m.shape[1] for m in made], pa.int32())
    return pa.RecordBatch.from_arrays([*columns, wide, pa.array([(m == 0).astype(np.uint8).tobytes() for m in made], pa.binary())], names=[*names, "wide", "m"])


def _matrix(r: dict) -> np.ndarray:
    return np.where(np.frombuffer(r["m"], np.uint8).reshape(-1, r["wide"]) > 0, 0, NEVER)


def _giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """digest and results of distinct giant texts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = lattice(path).reach
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                x = marked(text)
                for k, a in enumerate(range(0, len(x), chunk)):
                    low = max(0, a - reach)
                    body = x[low : a + chunk].encode("utf-8", "surrogatepass")
                    yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([k], pa.int32()), pa.array([a - low], pa.int32()), pa.array([body], pa.binary())], names=["digest", "k", "at", "body"])

    def each(columns: list[str], kinds: list[pa.DataType], step):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = lattice(path)
            for batch in batches:
                rows = [step(model, r) for r in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=columns)

        return run

    def text(r: dict) -> str:
        return r["body"].decode("utf-8", "surrogatepass")

    numbers = pa.list_(pa.int64())

    def transfer(model: Lattice, r: dict) -> tuple:
        return r["digest"], r["k"], model.matrix(text(r), r["at"]).reshape(-1).tolist()

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        n = int(len(rows[0]["m"]) ** 0.5)
        entry = np.full((1, n), NEVER)
        entry[0, 0] = 0
        out = []
        for r in rows:
            out.append(entry[0].tolist())
            entry = combined(entry, np.array(r["m"]).reshape(n, n))
        return pa.table([pa.array([r["digest"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()), pa.array(out, numbers)], names=["digest", "k", "entry"])

    def origins(model: Lattice, r: dict) -> tuple:
        x, at = text(r), r["at"]
        best, back = model.run(x, at, r["entry"])
        into = []
        for s in range(model.reach):
            end = len(x) - s
            while end > at:
                end = back[end] if back[end] >= 0 else -1
            into.append(at - end if end >= 0 and best[len(x) - s if len(x) - s >= 0 else 0] > NEVER // 2 else -1)
        return r["digest"], r["k"], into

    def exits(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: -r["k"])
        state, out = 0, []
        for r in rows:
            out.append(state)
            state = r["into"][state]
        return pa.table([pa.array([r["digest"] for r in rows]), pa.array([r["k"] for r in rows], pa.int32()), pa.array(out, pa.int32())], names=["digest", "k", "exit"])

    def emit(model: Lattice, r: dict) -> tuple:
        x = text(r)
        _, back = model.run(x, r["at"], r["entry"])
        ids, _ = model.trace(x, back, len(x) - r["exit"], r["at"])
        packed = np.array(ids, "<u4").tobytes()
        return r["digest"], r["k"], packed

    key = "digest string, k int, "
    chunks = stored(texts.mapInArrow(split, key + "at int, body binary").repartition("digest", "k"), "chunks")
    matrices = chunks.mapInArrow(each(["digest", "k", "m"], [pa.string(), pa.int32(), numbers], transfer), key + "m array<long>")
    entered = chunks.join(matrices.groupBy("digest").applyInArrow(scan, key + "entry array<long>"), ["digest", "k"])
    entered = stored(entered, "entries")
    into = entered.mapInArrow(each(["digest", "k", "into"], [pa.string(), pa.int32(), numbers], origins), key + "into array<long>")
    left = entered.join(into.groupBy("digest").applyInArrow(exits, key + "exit int"), ["digest", "k"])
    ids = left.mapInArrow(each(["digest", "k", "ids"], [pa.string(), pa.int32(), pa.binary()], emit), key + "ids binary")
    return ids.groupBy("digest").applyInArrow(_gather(path), f"digest string, {_RESULT}")


def _encoded(documents: DataFrame, path: str, giant: int, chunk: int, chains: bool) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= giant).mapInArrow(_plain(path, chains), f"doc_id long, {_RESULT}")
    long = rows.where(F.length("text") > giant).withColumn("digest", F.sha2("text", 256))
    done = (_giants if chains else _merged_giants)(long.groupBy("digest").agg(F.first("text").alias("text")), path, chunk)
    return short.unionByName(long.select("doc_id", "digest").join(done, "digest").drop("digest"))


def encode(documents: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and round_trip of every document row.

    The ids are those of the best-scoring chain, which for a BPE file are not the library's; see ``tokenized``.
    ``round_trip`` says whether decoding gives the text back. Null and empty texts have no pieces.
    Equal giant texts are encoded once. Other columns are not read; an empty table gives no rows.
    """
    return _encoded(documents, path, giant, chunk, True)


def tokenized(documents: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """As ``encode``, by the method the model file names: the library's merges for BPE, the best chain for unigram."""
    return _encoded(documents, path, giant, chunk, model_type(path) != BPE)
