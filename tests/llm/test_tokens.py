"""Token operators against the tokenizer libraries and exact round trips."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from collatio.llm import bitpack, bpe, packing, tokens
from collatio.llm.common import checkpoint_root

ODD = [None, "", " ", "\n", "a", "  two  blanks ", "x\n\n\ny", "it's don't 12th", "naïve 字🙂 ", "\tfoo bar\x1c", "aaaa" * 200, "<|endoftext|>", "w " * 3000, "Thanks, all. Thanks, all!! ### $$$"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_ranks()), special_tokens={}) if not hasattr(test_bpe_equals_the_library, "ref") else test_bpe_equals_the_library.ref
    test_bpe_equals_the_library.ref = ref
    own, table, decimal, _ = bpe.encoder(bpe.default_ranks(), bpe.default_pattern())
    want = ref.encode_ordinary(text)
    assert own.encode(text) == want
    assert own.decode(want) == text.encode()
    [(_, _, ids, ends)] = table.ids_of(pa.array([text, "", text]))
    assert ids.tolist() == want + want and decimal.rows(ids, ends)[0].decode().split() == [str(i) for i in want + want]
    t = tokens.piece_tokenizer(tokens.default_tokenizer())
    assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == t.raw(text) == want


def test_op7(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.digest(df).collect()}
    for i, t in enumerate(ODD):
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df)).collect()
    assert {r.doc_id: bytes(r.data) for r in back} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.digest(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.integers(0, 1 << 30))
def test_bit_packing_round_trip(bits, n, seed):
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, bits), n, bits) == ids).all()


def test_random_access(tmp_path):
    ids = np.arange(20_000, dtype=np.uint32) % 50_257
    path = tmp_path / "x.ids"
    path.write_bytes(bitpack.file_bytes(np.array([5]), np.array([0, len(ids)]), ids, 17))
    r = bitpack.Reader(str(path))
    for a, b in ((0, 0), (0, 1), (4095, 4097), (10_000, 20_000)):
        assert (r.read(a, b) == ids[a:b]).all()


def test_op5(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id")]
    got = bitpack.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).orderBy("start").collect()
    t = tokens.piece_tokenizer(tokens.default_tokenizer())
    keys = [-(1 << 63) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    want = sorted((str(i), zlib.crc32(np.array([*t.raw(x or ""), 0], "<u4").tobytes())) for i, x in rows)
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want
    assert bitpack.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_op4(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (99, "lorem ipsum " * 4000)]
    got = packing.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    t = tokens.piece_tokenizer(tokens.default_tokenizer())
    used: dict = {}
    for r in got:
        assert 0 < r.length <= 2048
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(len(t.raw(x or "")) + 1 for _, x in rows)
    assert sum(r.length for r in got) == total and len(used) == -(-total // 2048)
    ids = [*t.raw("lorem ipsum " * 4000), 0]
    for r in (r for r in got if r.doc_id == 99):
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert r.length == 2048 or r.piece == 0
    assert packing.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_genetic_crossover_keeps_every_item():
    import random

    rng = random.Random(2)
    lengths = [rng.randint(300, 1100) for _ in range(400)]
    island = packing.Island(lengths, 2048, 1)
    first = [island.founder(k > 0) for k in range(4)]
    child = island.cross(first[0], first[1])
    assert sorted(i for b in child for i in b) == list(range(400))
    _, best = island.evolve(first, 30)
    assert len(best) <= len(first[0]) and all(sum(lengths[i] for i in b) <= 2048 for b in best)


def test_op4_needs_fewer_sequences_than_best_fit_where_that_misses_the_bound(spark):
    import random

    rng = random.Random(5)
    lengths = [rng.randint(600, 750) for _ in range(900)]
    island = packing.Island(lengths, 2048, 1)
    best_fit = len(island.founder(False))
    assert best_fit > island.bound
    placed = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")).collect()
    used: dict = {}
    for r in placed:
        used.setdefault(r.sequence_id, []).append((r.offset, lengths[r.uid]))
    assert sorted(r.uid for r in placed) == list(range(900)) and island.bound <= len(used) < best_fit
    for places in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(places), sorted(places)[1:])) and sum(n for _, n in places) <= 2048


def test_the_session_names_the_checkpoint_folder(spark):
    assert checkpoint_root(spark)
