"""Texts as pieces that a byte-level BPE encodes each on its own, and a bounded table of encoded pieces.

The split pattern of the public vocabularies joins a space to the run after it and never lets a match pass a
single blank between two characters that aren't white space. So a text cut before each such space or line feed
gives the same ids piece by piece. Where it isn't certain that the neighbours are no white space (bytes of longer
characters that may be), there is no cut, and the longer piece is encoded as it stands.

Where the encoder splits words from what follows them, as those patterns do, a text is also cut between an ASCII letter
and ASCII punctuation: no match holds a letter and then such a mark.

Pieces are found and looked up with numpy, a slice of the texts at a time: a piece of up to 16 bytes is known by its
first eight bytes, its last eight and its length, so two pieces are never taken for each other; longer ones are kept
by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import slices, utf8
from .shingles import mix

#: ASCII that any of the libraries takes for white space.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First, second and last bytes that white space beyond ASCII has in UTF-8.
SECOND_OF_THREE, LAST_OF_THREE = np.zeros(256, bool), np.zeros(256, bool)
SECOND_OF_THREE[[0x80, 0x81, 0x9A]] = True
LAST_OF_THREE[[*range(0x80, 0x8B), 0x9F, 0xA8, 0xA9, 0xAF]] = True
FIRST_OF_THREE = (0xE1, 0xE2, 0xE3)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
MARK[[ord(c) for c in PUNCTUATION]] = True
#: Pieces that are looked up at once; fewer than a table holds.
CHUNK = 1 << 16


def starts_of(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where the pieces of the texts begin. data: all bytes; offsets: of the texts, and the end; marks: cut before punctuation too."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero((data == 32) | (data == 10))
    at = at[(at > 0) & (at + 1 < n)]
    before, after = data[at - 1], data[at + 1]
    at = at[~(WHITE[before] | WHITE[after] | edge[at] | edge[at + 1])]
    before, after = data[at - 1], data[at + 1]
    if (before >= 0x80).any():
        second, third = data[at - 2], data[at - 3]
        at = at[~((before >= 0x80) & (((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | (SECOND_OF_THREE[second] & LAST_OF_THREE[before] & np.isin(third, FIRST_OF_THREE))))]
        after = data[at + 1]
    if (after >= 0x80).any():
        second = data[np.minimum(at + 2, n - 1)]
        at = at[~(((after == 0xC2) & ((second == 0x85) | (second == 0xA0))) | (np.isin(after, FIRST_OF_THREE) & SECOND_OF_THREE[second]))]
    edge[at] = True
    if marks and n:
        edge[1:n] |= MARK[data[1:]] & LETTER[data[:-1]]
    edge[n] = False
    return np.flatnonzero(edge)


def matches(piece: str, pattern) -> list[str]:
    """The pattern's matches in a piece; one word with punctuation after it, the common case, needs no search."""
    if piece[:1] in (" ", "\n"):
        body = piece[1:]
        word = body.rstrip(PUNCTUATION)
        if word.isalpha():
            found = [piece[0] + word] if piece[0] == " " else ["\n", word]
            if len(word) < len(body):
                found.append(body[len(word) :])
            return found
    return pattern.findall(piece)


def ragged(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs of ``count`` elements from ``first`` on, one after another."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]


class Bounded(dict):
    """A dictionary that is emptied when it holds ``most`` entries, so memory is bounded at any vocabulary."""

    def __init__(self, most: int):
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()


class PieceTable:
    """Ids of pieces, each encoded once while the table holds it. encode: all ids of some pieces, and each one's number.

    When the table holds ``most`` pieces or ``ids_most`` ids, those that were asked for but once are dropped, or all if
    that leaves too many, so memory is bounded at any vocabulary.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[int], list[int]]], marks: bool, most: int = 400_000, ids_most: int = 4_000_000):
        self.encode, self.marks, self.most, self.ids_most = encode, marks, most, ids_most
        self.bits = max(17, (2 * most).bit_length())
        size = 1 << self.bits
        self.head, self.tail, self.size = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        self.entry = np.zeros(size, np.int32)
        self.first, self.count = np.zeros(most + CHUNK, np.int64), np.zeros(most + CHUNK, np.int64)
        self.asked = np.zeros(most + CHUNK, bool)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.longer: dict[bytes, int] = {}
        self.entries = self.ids = 0

    def make_room(self) -> None:
        old = np.flatnonzero(self.asked[: self.entries])
        if len(old) > self.most // 2 or self.count[old].sum() > self.ids_most // 2:
            old = old[:0]
        number = np.full(self.entries, -1, np.int64)
        number[old] = np.arange(len(old))
        at = np.flatnonzero(self.size)
        at = at[number[self.entry[at]] >= 0]
        kept = self.head[at], self.tail[at], self.size[at], number[self.entry[at]]
        ids, count = ragged(self.flat, self.first[old], self.count[old]), self.count[old]
        self.longer = {k: int(number[v]) for k, v in self.longer.items() if number[v] >= 0}
        self.size[:], self.asked[:] = 0, False
        self.add(*kept)
        self.entries, self.ids = len(old), len(ids)
        self.flat[: len(ids)] = ids
        self.count[: len(old)], self.first[: len(old)] = count, np.cumsum(count) - count

    def slot(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(head ^ mix(tail + size.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where it has none."""
        at, last = self.slot(head, tail, size), (1 << self.bits) - 1
        held = self.size[at]
        hit = (held == size) & (self.head[at] == head) & (self.tail[at] == tail)
        out = np.where(hit, self.entry[at], -1)
        todo = np.flatnonzero(~hit & (held != 0))
        while len(todo):
            at[todo] = s = (at[todo] + 1) & last
            held = self.size[s]
            hit = (held == size[todo]) & (self.head[s] == head[todo]) & (self.tail[s] == tail[todo])
            out[todo[hit]] = self.entry[s[hit]]
            todo = todo[~hit & (held != 0)]
        return out

    def add(self, head: np.ndarray, tail: np.ndarray, size: np.ndarray, entries: np.ndarray) -> None:
        """Different new pieces with their entries."""
        at, todo, last = self.slot(head, tail, size), np.arange(len(head)), (1 << self.bits) - 1
        while len(todo):
            s = at[todo]
            free = np.flatnonzero(self.size[s] == 0)
            _, one = np.unique(s[free], return_index=True)
            put = todo[free[one]]
            s = at[put]
            self.head[s], self.tail[s], self.size[s], self.entry[s] = head[put], tail[put], size[put], entries[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = np.where(self.size[at[todo]] != 0, (at[todo] + 1) & last, at[todo])

    def keep(self, pieces: list[bytes]) -> np.ndarray:
        """Entries of new pieces."""
        ids, counts = self.encode(pieces)
        while self.ids + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        new = slice(self.entries, self.entries + len(pieces))
        self.flat[self.ids : self.ids + len(ids)] = ids
        self.count[new] = counts
        self.first[new] = self.ids + np.cumsum(counts) - counts
        self.ids += len(ids)
        self.entries += len(pieces)
        return np.arange(new.start, new.stop)

    def entries_of(self, data: bytes, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.entries + len(starts) > len(self.first) or self.ids > self.ids_most:
            self.make_room()
        size = ends - starts
        cut = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
        head = (words[starts] << cut) >> cut
        tail = np.where(size > 8, words[np.maximum(ends - 8, 0)], np.uint64(0))
        shown = np.minimum(size, 17).astype(np.uint8)
        brief = slice(None) if size.max() <= 16 else np.flatnonzero(size <= 16)
        h, t, z = head[brief], tail[brief], shown[brief]
        got = self.find(h, t, z)
        self.asked[got[got >= 0]] = True
        missing = np.flatnonzero(got < 0)
        if len(missing):
            fresh: dict[bytes, int] = {}
            for k, a, b in zip(missing.tolist(), starts[brief][missing].tolist(), ends[brief][missing].tolist(), strict=True):
                fresh.setdefault(data[a:b], k)
            new = np.fromiter(fresh.values(), np.int64, len(fresh))
            self.add(h[new], t[new], z[new], self.keep(list(fresh)))
            got[missing] = self.find(h[missing], t[missing], z[missing])
        out = np.zeros(len(starts), np.int64)
        out[brief] = got
        if not isinstance(brief, slice):
            for k in np.flatnonzero(size > 16).tolist():
                piece = data[starts[k] : ends[k]]
                found = self.longer.get(piece)
                if found is None:
                    found = self.longer[piece] = int(self.keep([piece])[0])
                else:
                    self.asked[found] = True
                out[k] = found
        return out

    def ids_of(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For slices of a column of texts: first row, end, all ids, and where each row's ids begin (and the end)."""
        data, offsets = utf8(column)
        for i, j in slices(offsets):
            at = offsets[i : j + 1] - offsets[i]
            part = np.zeros(int(at[-1]) + 8, np.uint8)
            part[: at[-1]] = data[offsets[i] : offsets[j]]
            words = np.ndarray((len(part) - 7,), "<u8", part, strides=(1,))
            whole = part[: at[-1]].tobytes()
            starts = starts_of(part[: at[-1]], at, self.marks)
            ends = np.append(starts[1:], at[-1])
            counts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for a in range(0, len(starts), CHUNK):
                e = self.entries_of(whole, words, starts[a : a + CHUNK], ends[a : a + CHUNK])
                counts.append(self.count[e])
                found.append(ragged(self.flat, self.first[e], counts[-1]))
            before = np.zeros(len(starts) + 1, np.int64)
            np.cumsum(np.concatenate(counts), out=before[1:])
            yield i, j, np.concatenate(found), before[np.searchsorted(starts, at)]
