"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

A solution is a set of bins (sequences). Crossover injects whole well-filled bins of one parent into the other,
removes the bins that now hold an item twice, and best-fits the items that lost their bin. The corpus is dealt by
hash into shards of bounded size. Each shard is evolved on several islands, which are rows that different tasks
take; after each round an island's elite migrates to the next island. When the rounds end, the best island of a
shard gives its well-filled bins; items of the others migrate into a pool that is dealt and packed once more.

Defined cases: a null text is empty and takes its end id alone; every row, repeated ones too, is packed on its
own; ties are broken by random generators with fixed seeds; no rows give no sequences.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean, small_batches
from .tokens import default_tokenizer, ended, piece_tokenizer

CAPACITY, SHARD, ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2048, 4096, 3, 3, 10, 4
#: Bins filled to this share are kept when a shard is done; the items of others go to the pool.
KEPT = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(keys: pa.Array, ids: np.ndarray, ends: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Documents as pieces of up to ``capacity`` ids, of which only the first may be shorter."""
    size = np.diff(ends)
    count = -(-size // capacity)
    of = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    head = (size - 1) % capacity + 1
    length = np.where(number == 0, head[of], capacity)
    start = np.where(number == 0, 0, head[of] + (number - 1) * capacity)
    at = ends[of] + start
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [x.split()[0] for x in PIECES.split(", ")])


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Whole texts as token pieces; only longer documents are cut, and then the first piece may be shorter."""
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_tokenizer(path).table
        for batch in batches:
            keys = batch.column(0)
            for i, j, ids, ends in table.ids_of(batch.column(1)):
                ids, ends = ended(ids, ends, end_id)
                yield cut_pieces(keys.slice(i, j - i), ids, ends, capacity)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    small_batches(docs.sparkSession)
    return source.mapInArrow(lean(rows, stores=True), PIECES)


class Island:
    """Solutions of one shard: lists of bins, each a list of item numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rng = lengths, capacity, random.Random(seed)
        over_half = sum(2 * n > capacity for n in lengths)
        self.bound = max(-(-sum(lengths) // capacity), over_half)

    def place(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Best fit of items, in the order given, into the bins and as many new ones as it takes."""
        lengths, capacity = self.lengths, self.capacity
        by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_bits = 0
        for b, held in enumerate(bins):
            free = capacity - sum(map(lengths.__getitem__, held))
            by_free[free].append(b)
            open_bits |= 1 << free
        for item in items:
            n = lengths[item]
            fits = open_bits >> n
            if fits:
                free = (fits & -fits).bit_length() - 1 + n
                b = by_free[free].pop()
                if not by_free[free]:
                    open_bits &= ~(1 << free)
                bins[b].append(item)
            else:
                free, b = capacity, len(bins)
                bins.append([item])
            by_free[free - n].append(b)
            open_bits |= 1 << (free - n)
        return bins

    def largest_first(self, items) -> list[int]:
        return sorted(items, key=self.lengths.__getitem__, reverse=True)

    def fitness(self, bins: list[list[int]]) -> float:
        """Fewer bins first; among as many, the more unevenly filled, which leaves room that can be used."""
        lengths, c = self.lengths, self.capacity
        return sum((sum(map(lengths.__getitem__, b)) / c) ** 2 for b in bins) / len(bins) - len(bins)

    def founder(self, noisy: bool) -> list[list[int]]:
        items = range(len(self.lengths))
        if not noisy:
            return self.place(self.largest_first(items), [])
        noise = [n * self.rng.uniform(0.92, 1.08) for n in self.lengths]
        return self.place(sorted(items, key=noise.__getitem__, reverse=True), [])

    def cross(self, donor: list[list[int]], host: list[list[int]]) -> list[list[int]]:
        full = [sum(map(self.lengths.__getitem__, b)) for b in donor]
        line = sorted(full)[len(full) // 2]
        injected = [list(b) for b, n in zip(donor, full, strict=True) if n >= line and self.rng.random() < 0.5]
        taken = set().union(*injected) if injected else set()
        stay, displaced = [], []
        for b in host:
            if taken.isdisjoint(b):
                stay.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        # the emptiest bins that stay are opened too, so that room can be found anew
        stay.sort(key=lambda b: sum(map(self.lengths.__getitem__, b)))
        opened = self.rng.randint(0, max(1, len(stay) // 20))
        displaced += [i for b in stay[:opened] for i in b]
        return self.place(self.largest_first(displaced), injected + stay[opened:])

    def evolve(self, population: list[list[list[int]]], generations: int) -> tuple[float, list[list[int]]]:
        scored = sorted(((self.fitness(b), k, b) for k, b in enumerate(population)), reverse=True)
        for g in range(generations):
            if len(scored[0][2]) <= self.bound or len(scored) < 2:
                break
            (_, _, a), (_, _, b) = self.rng.sample(scored, 2)
            child = self.cross(a, b)
            scored = sorted([*scored, (self.fitness(child), len(population) + g, child)], reverse=True)[: len(scored)]
        return scored[0][0], scored[0][2]


STATE = "shard long, island int, uids binary, lengths binary, bins binary, fitness double"


def state(shard: int, island: int, uids: np.ndarray, lengths: np.ndarray, bins: list[list[int]], fitness: float) -> pa.Table:
    of = np.zeros(len(uids), np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return pa.table({"shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "uids": pa.array([uids.tobytes()], pa.binary()), "lengths": pa.array([lengths.tobytes()], pa.binary()), "bins": pa.array([of.tobytes()], pa.binary()), "fitness": pa.array([fitness], pa.float64())})


def bins_of(of: np.ndarray) -> list[list[int]]:
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def place_shards(items: DataFrame, count: int, capacity: int, level: int) -> DataFrame:
    """(uid, length, sequence_id, offset, filled) after all rounds; count: number of items."""
    shards = -(-count // SHARD)

    def settle(key, t):
        shard, island = key[0].as_py(), key[1].as_py()
        uids, lengths = t.column("uid").to_numpy(), t.column("length").to_numpy()
        order = np.argsort(uids)
        uids, lengths = uids[order], lengths[order]
        own = Island(lengths.tolist(), capacity, (level * 1_000_003 + shard) * 31 + island)
        fit, bins = own.evolve([own.founder(k > 0 or island > 0) for k in range(POPULATION)], GENERATIONS)
        return state(shard, island, uids, lengths, bins, fit)

    def migrate(key, t):
        shard, island = key[0].as_py(), key[1].as_py()
        uids = np.frombuffer(t.column("uids")[0].as_py(), np.int64)
        lengths = np.frombuffer(t.column("lengths")[0].as_py(), np.int64)
        own = Island(lengths.tolist(), capacity, (level * 1_000_003 + shard) * 31 + island + 7 * ISLANDS)
        elites = sorted(bins_of(np.frombuffer(x, np.int32)) for x in t.column("bins").to_pylist())
        fit, bins = own.evolve([*elites, own.founder(True)], GENERATIONS)
        return state(shard, island, uids, lengths, bins, fit)

    islands = F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island")
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"), islands)
    best = dealt.groupBy("shard", "island").applyInArrow(settle, STATE)
    for _ in range(ROUNDS - 1):
        to = F.explode(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
        best = best.select("shard", to.alias("island"), "uids", "lengths", "bins").groupBy("shard", "island").applyInArrow(migrate, STATE)
    winner = best.groupBy("shard").agg(F.max_by(F.struct("uids", "lengths", "bins"), F.struct("fitness", -F.col("island"))).alias("w")).select("shard", "w.*")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                uids, lengths, of = (np.frombuffer(row[k], t) for k, t in (("uids", np.int64), ("lengths", np.int64), ("bins", np.int32)))
                order = np.lexsort((uids, of))
                u, n, b = uids[order], lengths[order], of[order].astype(np.int64)
                before = np.cumsum(n) - n
                first = np.searchsorted(b, b)
                filled = np.bincount(b, weights=n)[b]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n), pa.array((level << 40 | row["shard"]) * 2 * SHARD * 8 + b), pa.array(before - before[first]), pa.array(filled.astype(np.int64))], ["uid", "length", "sequence_id", "offset", "filled"])

    return winner.mapInArrow(places, "uid long, length long, sequence_id long, offset long, filled long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items: (uid long, unique; length long, up to capacity). Returns (uid, sequence_id, offset)."""
    count = items.count()
    placed = checkpointed(place_shards(items, max(1, count), capacity, 0))
    loose = placed.where(F.col("filled") < KEPT * capacity).select("uid", "length")
    left = loose.count()
    final = placed.where(F.col("filled") >= KEPT * capacity)
    if left:
        final = final.unionByName(place_shards(loose, left, capacity, 1))
    return final.select("uid", "sequence_id", "offset")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    cut = checkpointed(pieces(docs, CAPACITY, tokenizer).withColumn("uid", F.monotonically_increasing_id()))
    return cut.join(pack(cut.select("uid", "length")), "uid").drop("uid")
