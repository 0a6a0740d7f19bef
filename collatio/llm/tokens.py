"""Ids of whole texts by the ``tokenizers`` library, with pieces encoded once each in a worker process."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .common import STORES
from .pieces import Bounded, PieceTable, matches


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PieceTokenizer:
    """``table.ids_of`` gives the ids of a column of texts, without special tokens; ``encode`` those of a list.

    Words go straight to the library's BPE model, each once, where its pre-tokenizer is the byte-level one that
    splits by the public pattern (a probe tells); pieces of other tokenizers go through the whole library.
    """

    PROBE = "It's a  probe, naïve\t12th  \n\n «x»!? 字 \u00a0\x1c don't 3.5%\n"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.letters = str.maketrans(byte_letters())
        self.words = Bounded(50_000)
        self.direct = self.by_words(self.PROBE) == self.raw(self.PROBE)
        self.table = PieceTable(self.many, self.direct)

    def raw(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def by_words(self, text: str) -> list[int]:
        out: list[int] = []
        for word in matches(text, self.pattern):
            ids = self.words.get(word)
            if ids is None:
                ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
                self.words.room(1)
                self.words[word] = ids
            out += ids
        return out

    def many(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """All ids of some pieces, and how many each has."""
        model, letters, one = self.tokenizer.model.tokenize, self.letters, self.by_words if self.direct else self.raw
        ids: list[int] = []
        counts: list[int] = []
        for piece in pieces:
            # a space and letters is one match of the pattern
            if self.direct and piece[:1] == b" " and piece[1:].decode().isalpha():
                found = [t.id for t in model(piece.decode("latin-1").translate(letters))]
            else:
                found = one(piece.decode())
            ids += found
            counts.append(len(found))
        return ids, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        out = []
        for _, _, ids, ends in self.table.ids_of(pa.array(texts, pa.string())):
            out += [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return out


def ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows with ``end_id`` after each row's, and where each row's begin (and the end)."""
    rows = len(ends) - 1
    out = np.full(len(ids) + rows, end_id, "<u4")
    more = ends + np.arange(rows + 1)
    own = np.ones(len(out), bool)
    own[more[1:] - 1] = False
    out[own] = ids
    return out, more


@lru_cache(maxsize=2)
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One for a worker process, kept from task to task."""
    return PieceTokenizer(path)


STORES.append(piece_tokenizer.cache_clear)
