"""SentencePiece encoding and decoding with a public vocabulary file.

The words of a batch that this worker has not met are joined to one text and indexed by a suffix array (suffixes up to the
longest piece). A binary search for every piece gives its range of occurrences; these are the edges of a graph
over positions. Sorted by their end, edges are relaxed: in pair merging every prefix has one last piece, and an edge
fits if the pair merging of the last piece before it and its own text gives just these two. Characters without a piece become
byte pieces, and so does a literal U+2581, which keeps the round trip exact. Null text: null ids.
"""

from __future__ import annotations

import os
import re
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
WIDE = 128
MANY = 150_000  # words kept from batch to batch
PART = 1_000_000  # characters of a batch split into words at a time
_loaded: dict[str, Coder] = {}


class Words(dict):
    """Numbers of words, in order of their first appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Coder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.bytes, self.out = {}, {}, {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.out.append(bytes([int(piece[3:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.out.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.ids))
        # ``\\0\\0`` and ``\\0\\1`` stand for a zero character and for a literal mark; no word looks like them.
        own = [[self.ids.get("\n", self.bytes[10])], [self.bytes[0]], [self.bytes[b] for b in MARK.encode()]]
        self.known = Words({"\n": 0, "\0\0": 1, "\0\1": 2})
        self.flat, self.ends, self.uses = np.array(sum(own, []), "<i4"), np.cumsum([0, *map(len, own)]), np.full(3, 2)
        self.fits: dict[tuple[str, str], bool] = {}
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        self.spelt: list[np.ndarray] = []
        self.widths: list[int] = []
        self.tried, self.fitted = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        many = [p for p in self.ids if len(p) > 1]
        self.many = np.array([self.number(p) for p in many], np.int64)
        points = np.frombuffer("".join(p.ljust(self.longest, "\0") for p in many).encode("utf-32-le"), "<u4")
        self.points, at = np.unique(points, return_inverse=True)  # code points of the pieces, and where each stands
        self.at, self.filled = at.reshape(len(many), -1), points.reshape(len(many), -1) != 0
        self.known_pairs()

    def known_pairs(self) -> None:
        """For every piece its place in the order of merges and the two parts it is last merged from; for every two parts of a piece that place."""
        splits = [(self.number(p[:i]), self.number(p[i:]), k, len(p)) for p, k in zip(self.ids, map(self.number, self.ids)) for i in range(1, len(p)) if (i == 1 or p[:i] in self.ids) and (i == len(p) - 1 or p[i:] in self.ids)]
        left, right, whole, width = np.array(splits, np.int64).reshape(-1, 4).T
        self.numbered = len(self.names)
        _, order = np.unique([-self.scores.get(n, 0.0) for n in self.names], return_inverse=True)
        # One number more stands for all characters that come later; they are in no piece.
        self.order = np.where(np.array([*self.widths, 1]) > 1, np.append(order, -1), -1)
        self.first, self.second = np.full((2, self.numbered + 1), -1, np.int64)
        self.made = self.order < 0
        keys = left << 32 | right
        by_key = np.argsort(keys)
        self.pairs, self.pair_order = np.append(-1, keys[by_key]), np.append(-1, self.order[whole[by_key]])  # no pair is -1
        for size in range(2, self.longest + 1):
            at = np.flatnonzero(width == size)
            at = at[self.apart(left[at], right[at], True)]
            self.first[whole[at]], self.second[whole[at]], self.made[whole[at]] = left[at], right[at], True
        # Learnt pieces are merged from parts of an earlier place. Others, such as runs of marks that all have one score, go by ``fit``.
        self.learnt, widths = self.order < 0, np.array([*self.widths, 1])
        for size in range(2, self.longest + 1):
            own = np.flatnonzero((widths == size) & (self.first >= 0))
            a, b = self.first[own], self.second[own]
            self.learnt[own] = self.learnt[a] & self.learnt[b] & (np.maximum(self.order[a], self.order[b]) < self.order[own])

    def apart(self, left: np.ndarray, right: np.ndarray, parts: bool = False) -> np.ndarray:
        """``fit`` for arrays: merges on both sides are undone, the latest first, and no pair over the edge may have come before one of them.

        With ``parts`` the pair itself may be a piece.
        """
        left, right = np.minimum(left, self.numbered), np.minimum(right, self.numbered)
        never = np.iinfo(np.int64).max
        ok = self.made[left] & self.made[right]
        live = np.flatnonzero(ok)
        limit = np.full(len(left), -1 if parts else never)
        while len(live):
            a, b = left[live], right[live]
            key = a << 32 | b
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            early = (self.pairs[at] == key) & (self.pair_order[at] < limit[live])
            ok[live[early]] = False
            go = ~early & ((self.order[a] >= 0) | (self.order[b] >= 0))
            live, a, b = live[go], a[go], b[go]
            # Of equal merges the one further left comes first.
            undo = self.order[a] > self.order[b]
            limit[live] = np.where(undo, self.order[a], self.order[b] + 1)
            left[live[undo]], right[live[~undo]] = self.second[a[undo]], self.first[b[~undo]]
        return ok

    def merged(self, text: str) -> list[str]:
        parts, score, none = list(text), self.scores.get, -np.inf
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def fit(self, left: str, right: str) -> bool:
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) > 50_000:
                self.fits.clear()
            got = self.fits[left, right] = self.merged(left + right) == [left, right]
        return got

    def number(self, piece: str) -> int:
        """A small number for a piece, or for a character without one."""
        got = self.numbers.get(piece)
        if got is None:
            got = self.numbers[piece] = len(self.names)
            self.names.append(piece)
            own = [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
            self.spelt.append(np.array(own, "<i4"))
            self.widths.append(len(piece))
        return got

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, number) of every occurrence of a piece, and of every character, by a suffix array."""
        size = len(text)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        alphabet, rank = np.unique(codes, return_inverse=True)
        # A suffix, as far as the longest piece, is a few numbers of several characters each: ranks from 1, none as 0.
        bits = (len(alphabet) + 1).bit_length()
        each = 63 // bits
        tail = np.concatenate([rank + 1, np.zeros(self.longest + each, np.int64)])

        def packed(rows: np.ndarray) -> list[np.ndarray]:
            """Numbers of ``each`` columns at a time, whatever the columns are."""
            out = []
            for first in range(0, self.longest, each):
                key = np.zeros_like(rows[0])
                for column in rows[first : first + each]:
                    key = key << bits | column
                out.append(key << bits * (each - len(rows[first : first + each])))
            return out

        suffixes = packed([tail[i : i + size] for i in range(self.longest)])
        array = np.lexsort(suffixes[::-1])
        keys = [k[array] for k in suffixes]
        place = np.searchsorted(alphabet, self.points)
        place[place == len(alphabet)] = 0
        own = np.where(alphabet[place] == self.points, place + 1, 0)[self.at]
        met = ((own > 0) | ~self.filled).all(axis=1)
        own, filled, found = own[met], self.filled[met], self.many[met]

        def bound(wanted: list[np.ndarray], after: bool) -> np.ndarray:
            """Binary search of all pieces at a time: how many suffixes are less, or with ``after`` not greater."""
            lo = np.searchsorted(keys[0], wanted[0], "left")
            hi = np.searchsorted(keys[0], wanted[0], "right")
            while len(live := np.flatnonzero(lo < hi)):
                mid = (lo[live] + hi[live]) // 2
                less = np.full(len(live), after)
                for k, w in zip(keys[::-1], wanted[::-1]):
                    x, y = k[mid], w[live]
                    less = (x < y) | ((x == y) & less)
                lo[live], hi[live] = np.where(less, mid + 1, lo[live]), np.where(less, hi[live], mid)
            return lo

        low = bound(packed(list(np.where(filled, own, 0).T)), False)
        high = bound(packed(list(np.where(filled, own, (1 << bits) - 1).T)), True)
        counts = high - low
        first = np.repeat(low - np.cumsum(counts) + counts, counts)
        starts = array[first + np.arange(len(first))]
        chars = np.array([self.number(chr(c)) for c in alphabet.tolist()])[rank]
        which = np.concatenate([np.repeat(found, counts), chars])
        start = np.concatenate([starts, np.arange(size)])
        length = np.array(self.widths)[which]
        return start + length, length, which

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fit`` for arrays of piece numbers; a left one of -1 stands for a word's begin."""
        keys = (left << 32) | right
        slot = (keys * np.int64(0x9E3779B97F4A7C1) >> np.int64(40)) & (len(self.tried) - 1)
        ok = left < 0
        hit = self.tried[slot] == keys
        ok[hit] |= self.fitted[slot[hit]]
        rest = np.flatnonzero(~hit & ~ok)
        if len(rest):
            learnt = self.learnt[np.minimum(left[rest], self.numbered)] & self.learnt[np.minimum(right[rest], self.numbered)]
            ok[rest[learnt]] = self.apart(left[rest[learnt]], right[rest[learnt]])
            for i in rest[~learnt].tolist():
                ok[i] = self.fit(self.names[left[i]], self.names[right[i]])
            self.tried[slot[rest]], self.fitted[slot[rest]] = keys[rest], ok[rest]
            clash = self.tried[slot[rest]] != keys[rest]  # two new pairs in one slot: the last one written stays
            self.fitted[slot[rest[~clash]]] = ok[rest[~clash]]
        return ok

    def learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, joined, and how many each has: edges of their joined text, sorted by position within the word, are relaxed for all words at a time."""
        text = "\n".join(fresh) + "\n"
        sizes = np.array([len(w) for w in fresh])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        end, length, which = self.edges(text)
        word = np.repeat(np.arange(len(fresh)), sizes + 1)[end - 1]
        depth = end - begin[word]
        # Beyond WIDE characters few words are left, and one step for each position would cost more than it saves.
        wide = sizes[word] > WIDE
        last = np.full(len(text) + 1, -1, np.int64)
        within = (depth <= sizes[word]) & (end - length >= begin[word])
        inside = np.flatnonzero(within & ~wide)
        inside = inside[np.argsort(depth[inside].astype(np.uint8), kind="stable")]
        bounds = np.searchsorted(depth[inside], np.arange(1, WIDE + 2))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if a == b:
                break
            step = inside[a:b]
            before = end[step] - length[step]
            # The place of a word's begin is also the end of the mark that parts it from the word before.
            left = np.where(before == begin[word[step]], -1, last[before])
            good = step[self.fitting(left, which[step])]
            last[end[good]] = which[good]
        rest = np.flatnonzero(within & wide)
        rest = rest[np.argsort(end[rest], kind="stable")]
        for e, n, k, w in zip(end[rest].tolist(), length[rest].tolist(), which[rest].tolist(), begin[word[rest]].tolist()):
            if e - n == w or self.fit(self.names[last[e - n]], self.names[k]):
                last[e] = k
        widths, at, live, path = np.array(self.widths), begin + sizes, np.arange(len(fresh)), []
        while len(live):
            piece = last[at[live]]
            path.append((live, piece))
            at[live] -= widths[piece]
            live = live[at[live] > begin[live]]
        owner, piece = (np.concatenate([x[i] for x in path[::-1]]) for i in (0, 1))
        order = np.argsort(owner.astype(np.uint16) if len(fresh) <= 1 << 16 else owner, kind="stable")
        owner, piece = owner[order], piece[order]
        ids, sizes = np.concatenate(self.spelt), np.array([len(x) for x in self.spelt])
        long = sizes[piece]
        edge = np.concatenate([[0], np.cumsum(long)])
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[piece] - edge[:-1], long) + np.arange(edge[-1])]
        return flat, np.diff(edge[np.searchsorted(owner, np.arange(len(fresh) + 1))])

    def spell(self, fresh: list[str]) -> None:
        """Put the ids of words numbered last into the table."""
        size, part, made = 0, [], []
        for w in fresh:
            part.append(w)
            size += len(w)
            if size > 400_000:
                made.append(self.learn(part))
                size, part = 0, []
        if part:
            made.append(self.learn(part))
        if made:
            self.flat = np.concatenate([self.flat, *[m[0] for m in made]]).astype("<i4")
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate([m[1] for m in made]))])
            self.uses = np.concatenate([self.uses, np.zeros(len(fresh), np.int64)])

    def gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, joined, and where each word's begin, and the last one's end."""
        long = np.diff(self.ends)[codes]
        edge = np.concatenate([[0], np.cumsum(long)])
        return self.flat[np.repeat(self.ends[codes] - edge[:-1], long) + np.arange(edge[-1])], edge

    def forget(self) -> None:
        """Keep words that several batches had, the most common if these are many."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > MANY // 2:
            first = keep[:3]
            keep = np.union1d(first, keep[np.argsort(-self.uses[keep], kind="stable")[: MANY // 2]])
        flat, edge = self.gathered(keep)
        names = np.array(list(self.known), object)[keep].tolist()
        self.known, self.flat, self.ends = Words(zip(names, range(len(names)))), flat, edge
        self.uses = np.where(np.arange(len(keep)) < 3, 2, 1)

    def split(self, text: str) -> list[str]:
        """Words with the mark before them, runs of marks and single odd characters; no piece reaches over their edges."""
        return re.findall(f"\n|\0|{MARK}+(?=[^{MARK}\n\0])[^{MARK}\n\0]+|{MARK}+|[^{MARK}\n\0]+", MARK + text.replace(" ", MARK))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The ids of each text. Part by part, so that what a worker holds does not grow with a batch; between them it keeps ``MANY`` words at most."""
        ends = np.cumsum([len(t or "") for t in texts]) // PART
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            out += self.part(texts[a:b])
            if len(self.known) > MANY:
                self.forget()
        return out

    def part(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [None if t is None else [] if t == "" else self.split(t.replace("\0", "\0\0").replace(MARK, "\0\1")) for t in texts]
        split = [self.marked(s) if s and "\0" in s else s for s in split]
        before, sizes = len(self.known), [len(s or ()) for s in split]
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(s for s in split if s)), np.int64, sum(sizes))
        self.spell(list(islice(self.known, before, None)))
        met = np.zeros(len(self.uses), bool)
        met[codes] = True
        self.uses += met
        flat, edge = self.gathered(codes)
        cuts = edge[np.cumsum([0, *sizes])].tolist()
        return [None if s is None else flat[a:b] for s, a, b in zip(split, cuts[:-1], cuts[1:])]

    def marked(self, s: list[str]) -> list[str]:
        """``\\0`` and what follows it as a word of their own, for a zero character or a literal mark, and the rest of a word."""
        parts, k = [], 0
        while k < len(s):
            if s[k] != "\0":
                parts.append(s[k])
                k += 1
                continue
            after = s[k + 1]
            parts.append("\0\0" if after == "\0" else "\0\1")
            if after != "\0" and after[1:]:
                parts.append(after[1:])
            k += 2
        return parts

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.out.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "surrogatepass")
        return text[1:] if text[:1] == " " else text


def coder(path: str) -> Coder:
    if path not in _loaded:
        _loaded[path] = Coder(path)
    return _loaded[path]


def encode(text: Column, path: str = VOCABULARY) -> Column:
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(coder(path).encode(list(texts)), dtype=object)

    return ids(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return pd.Series([coder(path).decode(x) for x in rows], dtype=object)

    return text(ids)
