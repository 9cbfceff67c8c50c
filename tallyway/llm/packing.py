"""Packing documents into sequences with a grouping genetic algorithm on distributed islands.

Pieces of exactly the sequence length fill a sequence each. The others are dealt by chance into shards of a bounded number
of pieces, and each shard is packed by a few islands. An island is one row: the lengths and a population of
packings. It starts from best-fit packings in different orders and breeds them: a child takes whole well-filled
sequences of one parent into the other, sequences that hold any of the same pieces are dissolved, and the pieces so displaced
go, largest first, where they fit best. Between epochs each island's best packing migrates to the next island of its
shard by a join. The sequences a shard leaves poorly filled are dealt into new shards and packed once more, so that what one
shard can't fill another can.

Everything a task holds is bounded by SHARD; the number of shards grows with the input.

Defined results: a null or empty text is its end id alone. Rows that repeat a doc_id, or have none, are packed each on
its own. No rows give no rows. Other columns don't matter.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyway.llm import bpe
from tallyway.llm.tables import cut

LENGTH = 1024
END = 2
#: Pieces that one island packs, on average.
SHARD = 12_000
ISLANDS, EPOCHS, POPULATION = 3, 4, 4
#: An island breeds on in an epoch until so many children after one another didn't join its population, at most GENERATIONS.
PATIENCE, GENERATIONS = 16, 200
#: Sequences of a shard filled less than this are packed again with those of other shards.
WELL_FILLED = 0.97
ROUNDS = 2


def best_fit(lengths: list[int], order: Iterable[int], room: list[tuple[int, int]], loads: list[int], bins: list[int], length: int) -> None:
    """Puts each piece of ``order`` into the fullest sequence it fits in, or a new one. room: sorted (free, sequence)."""
    for i in order:
        size = lengths[i]
        at = bisect_left(room, (size, -1))
        if at == len(room):
            b = len(loads)
            loads.append(size)
        else:
            _, b = room.pop(at)
            loads[b] += size
        bins[i] = b
        if loads[b] < length:
            insort(room, (length - loads[b], b))


def packed(lengths: list[int], order: list[int], length: int) -> list[int]:
    bins, loads = [0] * len(lengths), []
    best_fit(lengths, order, [], loads, bins, length)
    return bins


def loads_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, length: int) -> tuple[int, float]:
    """Fewer sequences first, then fuller ones."""
    loads = loads_of(lengths, bins)
    return -len(loads), float(((loads / length) ** 2).mean())


def crossed(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, length: int, rng: random.Random) -> np.ndarray:
    """``one`` with some whole well-filled sequences of ``other``; what that displaces, and the emptiest sequences' pieces, best-fit."""
    loads = loads_of(lengths, other)
    full = np.flatnonzero(loads >= WELL_FILLED * length)
    share = rng.uniform(0.05, 0.3)
    taken = np.zeros(len(loads), bool)
    taken[full] = [rng.random() < share for _ in range(len(full))]
    moved = taken[other]
    own = loads_of(lengths, one)
    broken = np.zeros(len(own), bool)
    broken[one[moved]] = True
    emptiest = np.argsort(own, kind="stable")[: max(1, len(own) // 50)]
    broken[emptiest] = True
    stays = ~broken[one]  # one that holds a moved piece is broken
    bins = np.full(len(lengths), -1, np.int64)
    bins[stays] = (np.cumsum(~broken) - 1)[one[stays]]
    bins[moved] = (np.cumsum(taken) - 1)[other[moved]] + int((~broken).sum())
    held = np.concatenate([own[~broken], loads[taken]])
    free = length - held
    open_ = np.argsort(free, kind="stable")
    open_ = open_[free[open_] > 0]
    room = list(zip(free[open_].tolist(), open_.tolist(), strict=True))
    left = np.flatnonzero(bins < 0)
    left = left[np.argsort(-lengths[left], kind="stable")]
    places = [0] * len(left)
    best_fit(lengths[left].tolist(), range(len(left)), room, held.tolist(), places, length)
    bins[left] = places
    return bins


def founders(lengths: np.ndarray, seed: int, length: int) -> list[np.ndarray]:
    """Best-fit packings: by falling length, and by falling length blurred at random."""
    rng = np.random.default_rng(seed)
    plain = lengths.tolist()
    orders = [np.argsort(-lengths, kind="stable")]
    orders += [np.argsort(-lengths * (1 + 0.1 * k * rng.random(len(lengths))), kind="stable") for k in range(1, POPULATION)]
    return [np.array(packed(plain, o.tolist(), length)) for o in orders]


def evolved(lengths: np.ndarray, population: list[np.ndarray], seed: int, length: int) -> list[np.ndarray]:
    """Breeds until nothing gets better any more; each child replaces the worst if it is better. Stops at the least number of sequences there can be."""
    rng = random.Random(seed)
    ranked = sorted(((fitness(lengths, b, length), k, b) for k, b in enumerate(population)), key=lambda x: x[0], reverse=True)
    least = -(-int(lengths.sum()) // length)
    failed = 0
    for made in range(GENERATIONS):
        if -ranked[0][0][0] <= least or failed == PATIENCE:
            break
        a, b = rng.sample(range(len(ranked)), 2) if len(ranked) > 1 else (0, 0)
        child = crossed(lengths, ranked[min(a, b)][2], ranked[max(a, b)][2], length, rng)
        worth = fitness(lengths, child, length)
        failed += 1
        # One that is worth what another is would only take its place.
        if worth > ranked[-1][0] and all(worth != x[0] for x in ranked):
            ranked[-1] = (worth, len(population) + made, child)
            ranked.sort(key=lambda x: x[0], reverse=True)
            failed = 0
    return [b for _, _, b in ranked]


STATE = "shard long, island int, rids array<long>, lengths array<int>, population array<array<int>>"
STATE_ARROW = pa.schema(
    [("shard", pa.int64()), ("island", pa.int32()), ("rids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32())))]
)


def state_row(shard: int, island: int, rids: np.ndarray, lengths: np.ndarray, group: list[np.ndarray]) -> pa.RecordBatch:
    """An island as a row of STATE; its lists are made of whole numpy arrays, as single numbers take most of an epoch's time."""
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    bins = pa.array(np.concatenate(group).astype(np.int32))
    packings = pa.ListArray.from_arrays(pa.array(np.arange(len(group) + 1, dtype=np.int32) * len(lengths)), bins)
    columns = [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), listed(pa.array(rids)), listed(pa.array(lengths.astype(np.int32))), listed(packings)]
    return pa.RecordBatch.from_arrays(columns, schema=STATE_ARROW)


def breed(islands: DataFrame, epoch: int, length: int) -> DataFrame:
    """One epoch on every island: a row in, a row out. ``elite``, where not null, joins the population first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r: batch.column(c)[r]
                lengths = get("lengths").values.to_numpy().astype(np.int64)
                shard, island = get("shard").as_py(), get("island").as_py()
                seed = (shard * 31 + island) * 31 + epoch
                if epoch == 0:
                    group = founders(lengths, seed, length)
                else:
                    group = [*get("population").values.flatten().to_numpy().reshape(-1, len(lengths)).astype(np.int64)]
                    if get("elite").is_valid:
                        group = [*group[: POPULATION - 1], get("elite").values.to_numpy().astype(np.int64)]
                group = evolved(lengths, group, seed, length)
                yield state_row(shard, island, get("rids").values.to_numpy(), lengths, group)

    return islands.mapInArrow(run, STATE)


def migrate(islands: DataFrame) -> DataFrame:
    """Gives each island, as ``elite``, the best packing of the island before it."""
    elites = islands.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
    return islands.join(elites, ["shard", "island"], "left")


def pack_shards(items: DataFrame, length: int, first_shard: int) -> DataFrame:
    """Packs ``items(rid, length)`` of fewer ids than a sequence; returns rid, length, shard, bin and the bin's load."""
    n = items.count()
    shards = max(1, -(-n // SHARD))
    dealt = items.select("rid", "length", (F.pmod(F.xxhash64("rid"), F.lit(shards)) + first_shard).alias("shard"))
    grouped = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("x"))
    islands = grouped.select(
        "shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.col("x.rid").alias("rids"), F.col("x.length").alias("lengths"),
    )
    width = max(1, min(shards * ISLANDS, 8 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = cut(breed(islands.repartition(width, "shard", "island"), 0, length))
    for epoch in range(1, EPOCHS):
        state = cut(breed(migrate(state), epoch, length))
    best = F.col("population")[0]
    scored = state.select("shard", "island", "rids", "lengths", best.alias("bins"), (-F.array_max(best)).alias("score"))
    top = scored.groupBy("shard").agg(F.max_by("island", F.struct("score", -F.col("island"))).alias("island"))
    rows = scored.join(top, ["shard", "island"]).select("shard", F.explode(F.arrays_zip("rids", "lengths", "bins")).alias("x"))
    placed = rows.select("shard", F.col("x.rids").alias("rid"), F.col("x.lengths").alias("length"), F.col("x.bins").alias("bin"))
    loads = placed.groupBy("shard", "bin").agg(F.sum("length").alias("load"))
    return placed.join(loads, ["shard", "bin"])


def pack(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where each of ``items(rid, length)`` goes: rid, sequence_id, offset. Lengths are 1 to ``length``; rid is unique."""
    items = items.select("rid", F.col("length").cast("int").alias("length"))
    whole = items.filter(F.col("length") == length).select("rid", (-F.col("rid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut(items.filter(F.col("length") < length))
    done: DataFrame | None = None
    for step in range(ROUNDS):
        placed = cut(pack_shards(rest, length, step << 40))
        last = step == ROUNDS - 1
        settled = placed if last else placed.filter(F.col("load") >= WELL_FILLED * length)
        done = settled if done is None else done.union(settled)
        rest = placed.filter(F.col("load") < WELL_FILLED * length).select("rid", "length")
    sequence = F.col("shard") * (1 << 20) + F.col("bin")
    members = done.groupBy(sequence.alias("sequence_id")).agg(F.array_sort(F.collect_list(F.struct("rid", "length"))).alias("x"))
    before = lambda i: F.aggregate(F.slice("x", 1, i), F.lit(0).cast("bigint"), lambda a, y: a + y["length"])
    offsets = F.transform("x", lambda y, i: F.struct(y["rid"].alias("rid"), before(i).alias("offset")))
    return members.select("sequence_id", F.explode(offsets).alias("x")).select("x.rid", "sequence_id", "x.offset").union(whole.select("rid", "sequence_id", "offset"))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Cuts each document's ids into pieces: rid (unique), doc_id, piece, start, length, ids_crc32 and, if asked, ids.

    A document longer than ``length`` is cut from its end, so that only its first piece may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            row, piece, starts, lengths, crcs = columns
            kept = []
            for r, ids in enumerate(bpe.encoded(batch.column("text"), tokenizer, end)):
                first = len(ids) % length or length
                for k, b in enumerate(range(first, len(ids) + 1, length)):
                    a = b - length if k else 0
                    for column, value in zip(columns, (r, k, a, b - a, bpe.crc(ids[a:b])), strict=True):
                        column.append(value)
                    if keep_ids:
                        kept.append(ids[a:b].astype(np.int32))
            made = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                made, names = [*made, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(made, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    made = docs.select("doc_id", "text").mapInArrow(run, schema)
    return cut(made.select(F.monotonically_increasing_id().alias("rid"), "*"))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = pieces(docs, tokenizer, length, end)
    return made.join(pack(made, length), "rid").drop("rid")


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and doc_ids and offsets of the pieces in them."""
    made = pieces(docs, tokenizer, length, end, keep_ids=True)
    parts = made.join(pack(made, length), "rid").groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("x"))
    return parts.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.doc_id").alias("doc_ids"), F.col("x.offset").alias("offsets"))
