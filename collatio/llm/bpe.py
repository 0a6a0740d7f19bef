"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton finds every vocabulary entry in a string;
the encoder takes the longest entry at each place and backtracks where two adjacent tokens could not stand next to
each other after the merges. Whether they can is decided from the two tokens alone and remembered. Each place is
given up at most once, so time is linear in the length.

Defined cases: null and empty texts have no ids; equal texts equal ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import STORES, lean, map_batches, small_batches
from .pieces import Bounded, PieceTable, matches, ragged

NEVER = 1 << 60


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_most: int = 400_000):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, ident in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (ident, len(token)))
        self.automaton.make_automaton()
        self.memo: dict[tuple[int, int], bool] = {}
        self.memo_most = memo_most
        self.shorter: dict[int, int | None] = {}
        self.spines: dict[int, tuple[list, list]] = {}

    def halves(self, ident: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        token = self.bytes_of[ident]
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= ident:
                raise ValueError(f"token {ident} isn't made by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def spine(self, ident: int) -> tuple[list, list]:
        """(left edge, right edge): tokens that lie at an edge while this one is being made, with the rank that ends each."""
        if (known := self.spines.get(ident)) is None:
            left, right = [(self.bytes_of[ident], NEVER)], [(self.bytes_of[ident], NEVER)]
            if halves := self.halves(ident):
                a, b = self.spine(halves[0])[0], self.spine(halves[1])[1]
                left += [(a[0][0], ident), *a[1:]]
                right += [(b[0][0], ident), *b[1:]]
            known = self.spines[ident] = (left, right)
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the border of a followed by b.

        A merge of x at a's right edge with y at b's left edge takes place if its rank comes before the merges
        that end x and y; among equal ranks the one further left is first.
        """
        if (known := self.memo.get((a, b))) is None:
            ranks = self.ranks
            known = True
            for x, x_ends in self.spine(a)[1]:
                for y, y_ends in self.spine(b)[0]:
                    r = ranks.get(x + y)
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.memo) >= self.memo_most:
                self.memo.clear()
            self.memo[a, b] = known
        return known

    def next_shorter(self, ident: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if ident not in self.shorter:
            token = self.bytes_of[ident]
            self.shorter[ident] = next((self.ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), None)
        return self.shorter[ident]

    def match(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        longest: list[int] = [0] * n
        for end, (ident, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end - size + 1] = ident  # ends ascend, so the longest stays
        open_at = [True] * (n + 1)
        out: list[int] = []
        ends: list[int] = []
        at, token = 0, longest[0]
        sizes = self.bytes_of
        while at < n:
            trial: int | None = token
            while trial is not None:
                end = at + len(sizes[trial])
                if open_at[end] and (not out or self.compatible(out[-1], trial)):
                    break
                trial = self.next_shorter(trial)
            if trial is None:  # nothing fits here: this place is given up, the token before it shortened
                open_at[at] = False
                token = out.pop()
                ends.pop()
                at = ends[-1] if ends else 0
                continue
            out.append(trial)
            ends.append(end)
            at = end
            token = longest[at] if at < n else 0
        return out

    def encode(self, text: str) -> list[int]:
        return [i for m in self.pattern.findall(text) for i in self.match(m.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Written:
    """What each id of a vocabulary is written as: flat bytes, and where each id's begin."""

    def __init__(self, of: dict[int, bytes]):
        size = np.zeros(max(of, default=0) + 1, np.int64)
        for i, x in of.items():
            size[i] = len(x)
        self.count, self.first = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def rows(self, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
        """All ids written one after another, and where each row begins (and the end)."""
        count = self.count[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        return ragged(self.flat, self.first[ids], count).tobytes(), at[ends].tolist()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[ByteBPE, PieceTable, Written, Written]:
    """One for a worker process: the encoder, its table of pieces, and ids in decimal (after a space) and as bytes."""
    bpe = ByteBPE(load_ranks(path), pattern)
    words = Bounded(50_000)

    def word(match: str) -> list[int]:
        if (known := words.get(match)) is None:
            words.room(1)
            known = words[match] = bpe.match(match.encode())
        return known

    def many(pieces: list[bytes]) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        counts: list[int] = []
        for piece in pieces:
            # a space and letters is one match of the pattern
            found = bpe.match(piece) if piece[:1] == b" " and piece[1:].decode().isalpha() else [i for m in matches(piece.decode(), bpe.pattern) for i in word(m)]
            ids += found
            counts.append(len(found))
        return ids, counts

    # other patterns may join a letter and a mark, so only the public one is cut there
    return bpe, PieceTable(many, pattern == default_pattern()), Written({i: f" {i}".encode() for i in bpe.bytes_of}), Written(bpe.bytes_of)


STORES.append(encoder.cache_clear)
IDS = "doc_id long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row; general interface, ids as an array."""
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path, pattern)[0]
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_batches(df.select(df[key].cast("long").alias("doc_id"), df[text].cast("string").alias("text")), rows, IDS, stores=True)


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, data) with the bytes that the ids stand for; null ids are empty."""
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path, pattern)[0]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_batches(df.select(df[key].cast("long").alias("doc_id"), df[ids].cast("array<int>").alias("ids")), rows, "doc_id long, data binary", stores=True)


def digest(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Number and hash of every text's ids, and the hash of their decoding."""
    path, pattern = path or default_ranks(), pattern or default_pattern()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, decimal, data = encoder(path, pattern)
        for batch in batches:
            keys = batch.column(0)
            for i, j, ids, ends in table.ids_of(batch.column(1)):
                hashes = [[hashlib.sha256(whole[a + skip : b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)] for skip, (whole, at) in ((1, decimal.rows(ids, ends)), (0, data.rows(ids, ends)))]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(np.diff(ends)), *map(pa.array, hashes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(lean(rows, stores=True), DIGEST)
