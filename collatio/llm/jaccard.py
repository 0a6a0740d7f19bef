"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

Documents link when 100 * |A & B| >= PERCENT * |A | B| for their sets of word shingles. Equal sets are one set from
the start. Two sets that link share a member among the first ``n - ceil(PERCENT n / 100) + 1`` of each, in any order
that is the same for all; the order here puts rare members first, by a count sketch of bounded size over the whole
corpus (a wrong count costs time, not links). So the sets that hold a member early make a block, and blocks are
cut into bands of set size, in which sizes don't rule a link out.

A set with no other of a fitting size in its block leaves the block, and of blocks with the same sets one is kept (the
words of a passage that documents share make as many such blocks). In the star rounds each set is compared with
a few leaders of its block and band, others in each round, so large groups of near copies become one component. What then isn't in one component of links is compared
in tiles of bounded size, all sets of neighbouring bands of a block, but for pairs that a component already holds or
a star round compared. Everywhere the bits that two bitmaps don't share bound the overlap from above; pairs that pass
are intersected exactly. No pair of sets that could join two components is left out.

A member that very many sets hold early is salted over tasks, from the first shuffle to the tiles; leaders are found
by partial aggregation; pairs of one leader are dealt in portions. Nothing that grows with the corpus comes to the
driver.

Defined cases: null, empty and blank texts have no members, and link with nothing; equal rows link; rows that share
a doc_id are rows of their own with the same id; a null doc_id counts as the lowest id and is given back as null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, portions, shared_folder, small_batches
from .components import components
from .shingles import bitmap, fold, mix, set_ids, sets_of

LOWEST = -(1 << 63)
#: The sketch: counters, and how many of them travel in a row.
COUNTERS, SLOT = 1 << 20, 1 << 14
#: Sets of a hot member that one task takes; rows of a tile's side; pairs of one leader in a portion.
HOT, TILE, PORTION = 2000, 512, 1000
#: Star rounds: leaders of each block that a set of it meets.
STARS = (1, 4, 8)
#: Bits of the filter that tells which documents' sets are fetched; when full it only stops sparing work.
BLOOM = 1 << 23
SEEN_MOST = 500_000


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("d"), docs["text"].cast("string").alias("text"), F.xxhash64(docs["text"].cast("string")).alias("h"))


SETS = "kind int, d long, h long, n int, s1 long, s2 long, data binary"


def describe(width: int):
    """Per document: size, name and bitmap of its set (the bitmap once a task and set); per task: its part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.uint32)
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in portions(whole)):
            members, ends = sets_of(batch.column(1), width)
            s1, s2 = set_ids(members, ends)
            counts += np.bincount((members >> np.uint64(44)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            maps: list[bytes | None] = []
            for i, name in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                new = ends[i] < ends[i + 1] and name not in seen
                if new:
                    if len(seen) >= SEEN_MOST:
                        seen.clear()
                    seen.add(name)
                maps.append(bitmap(members[ends[i] : ends[i + 1]]) if new else None)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0), batch.column(2), pa.array(np.diff(ends).astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(maps, pa.binary())], ["kind", "d", "h", "n", "s1", "s2", "data"])
        pack = zstandard.ZstdCompressor(level=1)
        used = [k for k in range(COUNTERS // SLOT) if counts[k * SLOT : (k + 1) * SLOT].any()]
        data = [pack.compress(counts[k * SLOT : (k + 1) * SLOT].tobytes()) for k in used]
        m = len(used)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.array(np.array(used, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(data, pa.binary())], ["kind", "d", "h", "n", "s1", "s2", "data"])

    return run


def sketch_of(parts: DataFrame) -> np.ndarray:
    """Counts of all counters; at most COUNTERS of them come to the driver, whatever the corpus."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for slot, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(unpack.decompress(data.as_py()), np.uint32)
                sums[slot] = sums.get(slot, np.zeros(SLOT, np.float32)) + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], ["slot", "sums"])

    out = np.zeros(COUNTERS, np.float32)
    for slot, data in parts.select(F.col("d").alias("slot"), "data").repartition(COUNTERS // SLOT, "slot").mapInArrow(lean(total), "slot long, sums binary").collect():
        out[slot * SLOT : (slot + 1) * SLOT] = np.frombuffer(data, np.float32)
    return out


EARLY = "tok long, salt int, salts int, s1 long, s2 long, n int"


def early_members(width: int, percent: int, shared):
    """The members of each set that may be the first that two linked sets share; once a task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        rank = np.minimum(255, np.floor(4 * np.log2(counts + 1))).astype(np.uint8)
        hot_from = max(HOT, 4 * float(counts.mean()))
        salts = np.where(counts > hot_from, np.ceil(counts / hot_from), 1).astype(np.int64)
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in portions(whole)):
            members, ends = sets_of(batch.column(1), width)
            s1, s2 = set_ids(members, ends)
            counter = (members >> np.uint64(44)).astype(np.int64)
            toks, keep = [], []
            for i, name in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                a, b = int(ends[i]), int(ends[i + 1])
                if a == b or name in seen:
                    continue
                if len(seen) >= SEEN_MOST:
                    seen.clear()
                seen.add(name)
                n = b - a
                first = n + (-percent * n // 100) + 1
                toks.append(a + np.argsort(rank[counter[a:b]], kind="stable")[:first])
                keep.append(i)
            if not toks:
                continue
            size = np.array([len(t) for t in toks])
            at, of = np.concatenate(toks), np.repeat(np.array(keep), size)
            k = salts[counter[at]].astype(np.uint64)
            # 0 stands for an unsalted member only
            salt = np.where(k > 1, 1 + s2[of].view(np.uint64) % k, 0)
            yield pa.RecordBatch.from_arrays([pa.array(members[at].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(s1[of]), pa.array(s2[of]), pa.array(np.diff(ends)[of].astype(np.int32))], ["tok", "salt", "salts", "s1", "s2", "n"])

    return run


BLOCKS = "tok long, salt int, salts int, s1 long, s2 long, n int"


def blocks(percent: int):
    """From rows ordered by (tok, salt, s1, s2): each set once in its block, if the block has another of a fitting size.

    A set of a salted member always stays, as it may meet those under other salts. ``tok`` is from here on a hash of all
    the block's sets, so blocks with the same sets are one (and should two others meet, only more sets are compared).
    """

    def settled(c: list[np.ndarray]) -> pa.RecordBatch:
        tok, salt, salts, s1, s2, n = c
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1])
        fresh = new.copy()
        fresh[1:] |= (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        at, group, sizes = np.flatnonzero(fresh), np.cumsum(new), n.astype(np.int64)
        at = at[np.lexsort((sizes[at], group[at]))]
        near = (group[at][1:] == group[at][:-1]) & (100 * sizes[at][:-1] >= percent * sizes[at][1:])
        keep = salts[at] > 1
        keep[1:] |= near
        keep[:-1] |= near
        at = at[keep]
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], group[at][1:] != group[at][:-1]]))
            names = np.add.reduceat(mix(s1[at].view(np.uint64) ^ mix(s2[at].view(np.uint64))), first)
            named = np.repeat(names, np.diff(np.append(first, len(at)))).view(np.int64)
            tok = tok.copy()
            tok[at] = np.where(salts[at] > 1, tok[at], named)
        return pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (tok, *c[1:])], [x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            c = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if rest is not None:
                c = [np.concatenate(x) for x in zip(rest, c, strict=True)]
            last = np.flatnonzero((c[0] != c[0][-1]) | (c[1] != c[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield settled([x[:cut] for x in c])
            rest = [x[cut:] for x in c]
        if rest is not None and len(rest[0]):
            yield settled(rest)

    return run


def words_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def may_link(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """False only if the bitmaps prove that the overlap is too small."""
    x, y = words_of(a), words_of(b)
    if len(x) > len(y):
        x = fold(x, len(y))
    elif len(y) > len(x):
        y = fold(y, len(x))
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return 100 * most >= percent * (na + nb - most)


PAIRS = "a long, b long"


def passing(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, ma, b, nb, mb = (c.to_pylist() for c in batch.columns)
            ok = np.array([may_link(*x, percent) for x in zip(ma, na, mb, nb, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[ok]), pa.array(np.array(b, np.int64)[ok])], ["a", "b"])

    return run


def tiles(percent: int):
    """From rows ordered by tile: pairs of its own sets, and of own with guest sets, that may link and aren't yet together."""

    def pairs(rows: list[dict]) -> tuple[list[int], list[int]]:
        rows.sort(key=lambda r: (r["guest"], r["u"]))
        own = [r for r in rows if not r["guest"]]
        size = min(len(r["data"]) for r in rows) // 8
        m = np.array([fold(words_of(r["data"]), size) for r in rows])
        n = np.array([r["n"] for r in rows], np.int64)
        comp, u, part = (np.array([r[k] for r in rows]) for k in ("comp", "u", "t"))
        guest = np.arange(len(rows)) >= len(own)
        left, right = [], []
        alone = rows[0]["i"] == rows[0]["j"]
        for k in range(len(own)):
            # within one tile each pair once; across two tiles, sets of the first with those of the second
            rest = np.arange(k + 1, len(rows)) if alone else np.arange(len(rows))
            rest = rest[(comp[rest] != comp[k])]
            if not alone:
                rest = rest[(part[rest] != part[k]) & (guest[rest] | (u[rest] > u[k]))]
            low, high = np.minimum(n[rest], n[k]), np.maximum(n[rest], n[k])
            rest = rest[100 * low >= percent * high]
            if not len(rest):
                continue
            most = np.minimum(n[k] - np.bitwise_count(m[k] & ~m[rest]).sum(axis=1).astype(np.int64), n[rest] - np.bitwise_count(m[rest] & ~m[k]).sum(axis=1).astype(np.int64))
            rest = rest[100 * most >= percent * (n[k] + n[rest] - most)]
            left += [int(u[k])] * len(rest)
            right += u[rest].tolist()
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        key = None
        left: list[int] = []
        right: list[int] = []
        for batch in batches:
            for r in batch.to_pylist():
                if (now := (r["tok"], r["band"], r["i"], r["j"])) != key:
                    if len(held) > 1:
                        a, b = pairs(held)
                        left += a
                        right += b
                    key, held = now, []
                held.append(r)
            if len(left) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
                left, right = [], []
        if len(held) > 1:
            a, b = pairs(held)
            left += a
            right += b
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def bloom_places(d: np.ndarray) -> list[np.ndarray]:
    x = d.view(np.uint64)
    h = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return [((h * np.uint64(m)) >> np.uint64(41)).astype(np.int64) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def bloom_of(ids: DataFrame) -> np.ndarray:
    """A filter of bounded size that all these ids pass."""
    per = BLOOM // 64

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BLOOM, bool)
        for batch in batches:
            for at in bloom_places(batch.column(0).to_numpy(zero_copy_only=False)):
                found[at] = True
        words = np.packbits(found, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at // (per // 64)), pa.array((at % (per // 64)).astype(np.int32)), pa.array(words[at])], ["slot", "at", "word"])

    rows = ids.select("d").mapInArrow(lean(bits), "slot long, at int, word long").groupBy("slot", "at").agg(F.bit_or("word").alias("word"))
    joined = rows.groupBy("slot").agg(F.collect_list(F.struct("at", "word")).alias("w"))
    out = np.zeros(BLOOM // 64, np.int64)
    for slot, words in joined.collect():
        for w in words:
            out[slot * (per // 64) + w["at"]] = w["word"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def fetched(width: int, shared):
    """Sets of the documents that pass the filter, once a task and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in portions(whole)):
            d = batch.column(0).to_numpy()
            hit = np.ones(len(d), bool)
            for at in bloom_places(d):
                hit &= passes[at]
            if not hit.any():
                continue
            members, ends = sets_of(batch.column(1).filter(pa.array(hit)), width)
            s1, s2 = set_ids(members, ends)
            keep, data = [], []
            for i, name in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if ends[i] < ends[i + 1] and name not in seen:
                    if len(seen) >= SEEN_MOST:
                        seen.clear()
                    seen.add(name)
                    keep.append(i)
                    data.append(members[ends[i] : ends[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(s1[keep]), pa.array(s2[keep]), pa.array(data, pa.binary())], ["s1", "s2", "data"])

    return run


def intersected(percent: int):
    """From rows ordered by (a, portion, b), the leader's own set first: pairs whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, key = np.zeros(0, np.uint64), None
        for batch in batches:
            left, right = [], []
            for a, portion, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(data, np.uint64)
                if b is None:
                    leader, key = x, (a, portion)
                elif key == (a, portion):
                    both = len(np.intersect1d(leader, x, assume_unique=True))
                    if 100 * both >= percent * (len(leader) + len(x) - both):
                        left.append(a)
                        right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set numbers whose sets link, by exact intersection."""
    spark = pairs.sparkSession
    pairs = checkpointed(pairs)
    need = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct().join(sets.select("u", "d", "s1", "s2"), "u")
    need = checkpointed(need)
    passes = spark.sparkContext.broadcast(bloom_of(need))
    got = rows.select("d", "text").mapInArrow(lean(fetched(width, passes)), "s1 long, s2 long, data binary")
    # each task gives a set once; the join's partitioning serves the aggregation too
    members = got.join(need.select("u", "s1", "s2"), ["s1", "s2"]).groupBy("s1", "s2", "u").agg(F.first("data").alias("data")).select("u", "data")
    members = checkpointed(members)
    passes.unpersist()
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("p"))
    dealt = pairs.join(portions, "a").select("a", F.pmod(F.xxhash64("b"), F.col("p")).cast("int").alias("portion"), "b")
    guests = dealt.join(members, dealt["b"] == members["u"]).select("a", "portion", "b", "data")
    leaders = portions.select("a", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("portion")).join(members, F.col("a") == members["u"]).select("a", "portion", F.lit(None).cast("long").alias("b"), "data")
    met = guests.unionByName(leaders).repartition("a", "portion").sortWithinPartitions("a", "portion", F.asc_nulls_first("b"))
    return checkpointed(met.mapInArrow(lean(intersected(percent)), PAIRS))


def every_salt(salts: str):
    """One row for each salt under which a block's rows lie."""
    return F.explode(F.when(F.col(salts) > 1, F.sequence(F.lit(1), F.col(salts))).otherwise(F.array(F.lit(0)))).alias("salt")


def link_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(d, h, n, comp): every row of docs with its text's hash, the size of its set and a number of its component (null without members)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = rows_of(docs)
    told = rows.mapInArrow(lean(describe(width)), SETS)
    folder = shared_folder(spark, "jaccard")
    told.write.parquet(f"{folder}/sets")
    told = spark.read.schema(SETS).parquet(f"{folder}/sets")
    listed = told.where("kind = 0").drop("kind")
    sketch = spark.sparkContext.broadcast(sketch_of(told.where("kind = 1")))
    sets = checkpointed(listed.where("n > 0").groupBy("s1", "s2").agg(F.min("d").alias("d"), F.max("n").alias("n")).withColumn("u", F.monotonically_increasing_id()))
    # the band of a size: two sizes that don't rule a link out lie in the same or in neighbouring bands
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100) * 1.0000001)).cast("int")
    early = rows.mapInArrow(lean(early_members(width, percent, sketch)), EARLY).repartition("tok", "salt").sortWithinPartitions("tok", "salt", "s1", "s2")
    met = early.mapInArrow(lean(blocks(percent)), BLOCKS)
    # rows of one set lie together after the join, so its equal blocks are met without another shuffle
    held = checkpointed(met.join(sets.select("s1", "s2", "u"), ["s1", "s2"]).select("s1", "s2", "tok", band.alias("band"), "salt", "salts", "u", "n").distinct().drop("s1", "s2"))
    used = held.select("u").distinct().join(sets.select("u", "s1", "s2"), "u")
    maps = checkpointed(listed.where("data is not null").join(used, ["s1", "s2"]).groupBy("s1", "s2", "u").agg(F.max("n").alias("n"), F.first("data").alias("data")).drop("s1", "s2"))

    def marked(pairs: DataFrame) -> DataFrame:
        x = maps.select(F.col("u").alias("a"), F.col("n").alias("na"), F.col("data").alias("ma"))
        y = maps.select(F.col("u").alias("b"), F.col("n").alias("nb"), F.col("data").alias("mb"))
        return pairs.join(x, "a").join(y, "b").select("a", "na", "ma", "b", "nb", "mb").mapInArrow(lean(passing(percent)), PAIRS)

    def pairs_of(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    def placed(near: DataFrame) -> DataFrame:
        return checkpointed(held.join(near.withColumnRenamed("node", "u"), "u", "left").select("tok", "band", "salt", "salts", "u", "n", F.coalesce("root", "u").alias("comp")))

    now, compared, links, near = held.withColumn("comp", F.col("u")), None, None, None
    member = F.struct("u", "n", "comp")
    for turn, count in enumerate(STARS):
        # the least set leads first, as then all blocks of a group have the same leader; later ones are drawn for each block
        chosen = [F.min(member)] if turn == 0 else [F.min_by(member, F.xxhash64("u", "tok", F.lit(turn), F.lit(k))) for k in range(count)]
        blocks_now = now.groupBy("tok", "band").agg(*[c.alias(f"l{k}") for k, c in enumerate(chosen)], F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("salts").alias("salts")).where("lo <> hi")
        leaders = blocks_now.select("tok", "band", "salts", F.explode(F.array_distinct(F.array(*[f"l{k}" for k in range(len(chosen))]))).alias("l")).select("tok", "band", "l", every_salt("salts"))
        fits = 100 * F.least("n", "l.n").cast("long") >= percent * F.greatest("n", "l.n").cast("long")
        star = now.join(leaders, ["tok", "band", "salt"]).where((F.col("comp") != F.col("l.comp")) & fits).select("u", F.col("l.u").alias("lead")).select(*pairs_of("u", "lead")).distinct()
        star = checkpointed(star if compared is None else star.join(compared, ["a", "b"], "left_anti"))
        compared = star if compared is None else compared.unionByName(star)
        found = verified(marked(star), sets, rows, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
        links = found if near is None else near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found)
        near = components(links)
        now = placed(near)
    # a band of a block meets itself and, as a guest, the band below; where one component holds all, or both of the
    # two sets that a star compared, nothing is left to do
    per = now.groupBy("tok", "band").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("salts").alias("salts"))
    sides = per.select("tok", "band", F.col("m").alias("own"), F.lit(0).cast("long").alias("guests"), "lo", "hi", "salts").unionByName(per.select("tok", (F.col("band") - 1).alias("band"), F.lit(0).cast("long").alias("own"), F.col("m").alias("guests"), "lo", "hi", "salts"))
    todo = sides.groupBy("tok", "band").agg(F.sum("own").alias("own"), F.sum("guests").alias("guests"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("salts").alias("salts"))
    todo = todo.where("own > 0 and lo <> hi and not (own = 2 and guests = 0)")
    cut = todo.select("tok", "band", F.ceil(F.greatest("own", "guests") / TILE).cast("int").alias("t"), every_salt("salts"))
    own = now.select("tok", "band", "salt", "u", "comp", F.lit(False).alias("guest"))
    guest = now.select("tok", (F.col("band") - 1).alias("band"), "salt", "u", "comp", F.lit(True).alias("guest"))
    tiled = own.unionByName(guest).join(cut, ["tok", "band", "salt"]).withColumn("k", F.pmod(F.xxhash64("u"), F.col("t")).cast("int"))
    tiled = tiled.select("*", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("other")).select("tok", "band", "u", "comp", "guest", F.col("k").alias("t"), F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"))
    tiled = tiled.join(maps, "u").repartition("tok", "band", "i", "j").sortWithinPartitions("tok", "band", "i", "j")
    more = tiled.select("tok", "band", "i", "j", "u", "comp", "guest", "t", "n", "data").mapInArrow(lean(tiles(percent)), PAIRS)
    more = more.select(*pairs_of("a", "b")).distinct().join(compared, ["a", "b"], "left_anti")
    found = verified(more, sets, rows, width, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    final = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(found))
    named = sets.select("s1", "s2", "u").join(final.withColumnRenamed("node", "u"), "u", "left").select("s1", "s2", F.coalesce("root", "u").alias("comp"))
    return listed.select("d", "h", "n", "s1", "s2").join(named, ["s1", "s2"], "left").select("d", "h", "n", "comp")


def digest(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id that links reach."""
    rows = checkpointed(link_components(docs, width, percent))
    # written, so that the join has a shuffle of its own on either side and can split the rows of a large group
    least = checkpointed(rows.where("comp is not null").groupBy("comp").agg(F.min("d").alias("least")))
    given = lambda c: F.when(F.col(c) == LOWEST, None).otherwise(F.col(c))
    return rows.join(least, "comp", "left").select(given("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("least").isNull(), given("d")).otherwise(given("least")).alias("component_id"))


def stage(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id; documents without words all stay.

    Of several with that id the one whose text has the least hash stays. Rows with equal doc_id and text count as one
    document.
    """
    rows = checkpointed(link_components(docs, width, percent))
    kept = rows.where("comp is not null").groupBy("comp").agg(F.min(F.struct("d", "h")).alias("k")).select(F.col("k.d").alias("_kept"), F.col("k.h").alias("_h"))
    alone = rows.where("comp is null").select(F.col("d").alias("_kept"), F.col("h").alias("_h"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("_kept"), F.xxhash64(docs["text"].cast("string")).alias("_h"))
    return whole.join(kept.unionByName(alone).distinct(), ["_kept", "_h"]).dropDuplicates(["_kept", "_h"]).select("_row.*")


#: Plain SQL of ``digest`` for unique ids: all pairs of sets that share a shingle, then everything that links reach.
ORACLE_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM w),
m AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
linked AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT edges.b, reach.c FROM reach JOIN edges ON edges.a = reach.d)
SELECT s.doc_id, len(s.s) AS n_shingles, min(reach.c) AS component_id FROM s JOIN reach ON reach.d = s.doc_id GROUP BY s.doc_id, len(s.s)"""
