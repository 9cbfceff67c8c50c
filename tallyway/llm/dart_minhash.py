"""Near-duplicates by DartMinHash sketches and a banded join.

A document is a weighted set of word shingles. Each element owns a strip of the plane: its weight wide, with ranks
upwards. Darts are thrown by hashing alone: along the ranks they arrive as a Poisson process whose gaps come from
hashes of the element, so two documents that share an element see the same darts in it. A dart counts for a
document if it lies within the element's weight; it is hashed to one of ``k`` coordinates, and each coordinate keeps
the dart of lowest rank. Two documents agree in a coordinate with the probability of their weighted Jaccard
similarity, and a sketch costs darts in proportion to k log k, not to k times the set.

Coordinates are grouped in bands; documents with an equal band meet in a bucket. Buckets never emit all pairs: copies
with equal words are one node from the start, each bucket links its members to its smallest node, an exact check
of the shingle sets decides, and only what is still in different classes within a bucket is compared further.

Defined results: a text without words (null, empty, blank) has class of its own, its doc_id. Texts of fewer words
than a shingle are alike only where their words are equal. Rows with a null doc_id have a null class. A doc_id is taken to
name one text: where rows repeat it with another text, all get one class, found by the bands of one of the texts. Other
columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.llm import bpe
from tallyway.llm.components import components
from tallyway.llm.tables import cut, fresh, let, small
from tallyway.llm.text import window_hashes, word_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 6
#: Times that what can't match is taken out, each with fewer shingles left to share.
NARROWINGS = 3
#: Shingles by which bounds on an overlap are looser than the exact check.
SLACK = 1e-6
#: Darts expected beyond k ln k, as a multiple of k: so few sketches need a second, longer throw.
EXTRA = 3.0
#: Darts held at once while a batch is sketched.
AT_ONCE = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64-bit words."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def strips(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements cut into strips of weight [0, 1), [1, 2), [2, 4), [4, 8)...: seed, start, width and element of each."""
    parts = [(h, np.zeros(len(h)), np.ones(len(h)), np.arange(len(h)))]
    start, width, level = 1.0, 1.0, 1
    while (over := np.flatnonzero(w > start)).size:
        parts.append((mix(h[over] + np.uint64(level)), np.full(over.size, start), np.full(over.size, width), over))
        start, width, level = start + width, start + width, level + 1
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def sketches(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """A row of ``k`` dart ids for each set; sets lie one after the other in ``hashes``, none is empty."""
    out = np.zeros((len(sizes), k), np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seed, start, width, of = strips(mix(hashes.astype(np.uint64)), weights)
    total = np.bincount(owner, weights, len(sizes))
    doc, most = owner[of], weights[of]
    reach = k * (math.log(k) + EXTRA) / total
    todo = np.ones(len(sizes), bool)
    while todo.any():
        mine = todo[doc]
        s, lo, wide, d, top = seed[mine], start[mine], width[mine], doc[mine], most[mine]
        rank, found, throw = np.zeros(len(s)), [], 0
        while len(s):
            s = mix(s + np.uint64(0x9E3779B97F4A7C15))
            rank = rank - np.log(unit(s)) / wide
            near = rank <= reach[d]
            s, lo, wide, d, top, rank = s[near], lo[near], wide[near], d[near], top[near], rank[near]
            dart = mix(s ^ np.uint64(0xD6E8FEB86659FD93))
            within = lo + wide * unit(mix(dart + np.uint64(1))) <= top
            found.append((d[within], dart[within], rank[within]))
            throw += 1
        d, dart, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        slot = d * k + (mix(dart + np.uint64(2)) % np.uint64(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        hit = np.zeros(out.size, bool)
        hit[slot] = True
        out.reshape(-1)[slot[late_first]] = dart[late_first]  # the earliest is written last
        todo &= ~hit.reshape(len(sizes), k).all(axis=1)
        reach = reach * 2
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each ``rows`` neighbouring coordinates; equal bands of different numbers differ."""
    bands = sketch.shape[1] // rows
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        key = mix(key ^ sketch[:, r::rows][:, :bands])
    return key.view(np.int64)


def with_bands(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Replaces array columns ``elements`` (64-bit hashes) and ``weights`` (positive, or null for ones) by ``bands``.

    ``sets`` also has doc_id and key, which stay. Empty sets get no bands.
    """
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.release()
        for batch in batches:
            elements, given = batch.column("elements"), batch.column("weights")
            sizes = np.diff(elements.offsets.to_numpy())
            flat, at = elements.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
            weights = given.flatten().to_numpy(zero_copy_only=False) if given.null_count < len(given) else np.ones(len(flat))
            full = np.flatnonzero(sizes)
            keys = np.zeros((len(full), bands), np.int64)
            step = max(1, int(AT_ONCE / (k * (math.log(k) + EXTRA))))
            first = 0
            while first < len(full):
                last = first + step  # fewer where the sets themselves are large
                while last > first + 1 and sizes[full[first:last]].sum() > AT_ONCE:
                    last = first + (last - first) // 2
                rows_now = full[first:last]
                part = np.concatenate([np.arange(at[i], at[i + 1]) for i in rows_now])
                keys[first:last] = band_keys(sketches(flat[part], weights[part], sizes[rows_now], k), rows)
                first = last
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("n"), lists], ["doc_id", "key", "n", "bands"])

    return sets.select("doc_id", "key", F.size("elements").alias("n"), "elements", "weights").mapInArrow(run, "doc_id long, key string, n int, bands array<long>")


def key_of(word_array: Column) -> Column:
    """Equal for equal words; null without words."""
    return F.when(F.size(word_array) > 0, F.md5(F.array_join(word_array, " ")))


def shingled(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id and ``keep``, key of the words, and the distinct shingles of each whole text, of weight one."""
    both = lambda w: F.struct(
        key_of(w).alias("key"),
        let(word_hashes(w), lambda h: F.array_distinct(window_hashes(h, SHINGLE))).alias("elements"),
    )
    made = docs.select("doc_id", *keep, let(words(F.col("text")), both).alias("s"))
    return made.select("doc_id", *keep, "s.key", "s.elements", F.lit(None).cast("array<double>").alias("weights"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and its shingles, made again from the texts of ``wanted(node, key)`` alone."""
    texts = docs.select("doc_id", "text").join(small(wanted.select("node", F.col("key").alias("wanted"))), F.col("doc_id") == F.col("node"))
    return shingled(texts, "wanted").filter("key = wanted").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("node"), "elements")


def similar(sets: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Of ``pairs(a, b)``, those whose shingle sets have a Jaccard similarity of ``least`` or more, checked exactly."""
    a, b = (sets.select(F.col("node").alias(c), F.col("elements").alias(f"{c}_set")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("a_set", "b_set"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", shared.alias("shared"), (F.size("a_set") + F.size("b_set")).alias("total"))
    return both.filter(F.col("shared") >= least * (F.col("total") - F.col("shared"))).select("a", "b")


def remaining(open_: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of ``open_(bucket, node, label)`` in one bucket, of different labels, that can still be similar.

    A shingle that one open node alone has is in no overlap. So a pair shares at most the smaller number of other
    shingles, and its similarity is bounded by sizes alone; that settles nearly all pairs of a large group of loose copies
    without looking at their sets. What can't match any set, or not even the smallest of a bucket, leaves it first.
    """
    # Looser than similar() by more than doubles can be off, so that no pair at exactly ``least`` is lost.
    reaches = lambda able, total: able * (1 + least) >= least * total - SLACK
    left = open_
    for _ in range(NARROWINGS):
        held = sets.join(left.select("node").distinct(), "node", "left_semi")
        alone = held.select("node", F.explode("elements").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
        own = alone.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
        sized = held.select("node", F.size("elements").alias("size")).join(own, "node", "left")
        able = cut(sized.select("node", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("able")).filter(F.col("able") >= least * F.col("size") - SLACK))
        placed = cut(left.select("bucket", "node", "label").join(able, "node"))
        bounds = placed.groupBy("bucket").agg(
            F.min("size").alias("smallest"), F.max("able").alias("ablest"), F.min("label").alias("x"), F.max("label").alias("y")
        ).filter("x < y")
        fits = reaches(F.least("able", "ablest"), F.col("size") + F.col("smallest"))
        left = cut(placed.join(bounds, "bucket").filter(fits).drop("smallest", "ablest", "x", "y"))
    # Of the buckets a pair shares, only the first brings it out.
    shelves = left.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("all"))
    sided = cut(left.join(shelves, "node"))
    a, b = (sided.select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "label", "size", "able", "all")]) for x in ("a", "b"))
    fits = reaches(F.least("a_able", "b_able"), F.col("a_size") + F.col("b_size"))
    first = F.array_intersect("a_all", "b_all")[0] == a["bucket"]
    met = a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a_label") < F.col("b_label")) & fits & first)
    return met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and class_id, the smallest doc_id of its class.

    A class is a connected component of the documents whose 5-word shingle sets have a Jaccard similarity of
    ``least`` or more, of those that meet in a bucket: at similarity s that fails with probability
    (1 - s**rows)**bands, 2e-5 at 0.8 and 1e-9 at 0.86 with the given bands.
    """
    found = cut(with_bands(shingled(docs), bands, rows))
    nodes = cut(found.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("node")))
    banded = found.select("key", F.col("doc_id").alias("node"), "bands").filter(F.size("bands") > 0)
    first = banded.join(nodes, ["key", "node"], "left_semi").dropDuplicates(["node"])
    members = first.select("node", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = cut(members.join(buckets, "bucket"))
    sets = cut(sets_of(docs, met.select("node").distinct().join(nodes, "node")))
    stars = met.filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    linked = cut(similar(sets, stars, least))
    label = components(linked)

    # What a star leaves open: pairs in one bucket that are in different classes and weren't compared.
    marked = met.join(label, "node", "left").select("bucket", "node", "leader", F.coalesce("label", "node").alias("label"))
    mixed = marked.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("bucket")
    open_ = cut(marked.join(mixed, "bucket").filter("node != leader").select("bucket", "node", "label"))
    rest = cut(remaining(open_, sets, least))
    label = components(linked.union(similar(sets, rest, least)))

    named = nodes.join(label, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    return found.select("doc_id", "key").join(named, "key", "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")).alias("class_id")
    )


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose class has a smaller doc_id, and without repeats of a row.

    Texts without words and rows without a doc_id stay.
    """
    found = cut(classes(docs, least))
    copies = found.filter("doc_id <> class_id").select("doc_id").distinct()
    left = docs.join(small(cut(copies)), "doc_id", "left_anti").select(*docs.columns)
    repeated = cut(found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    again = small(repeated)
    key = fresh(docs, "text_key")
    same = left.join(again, "doc_id", "left_semi").withColumn(key, F.md5(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", key])
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(same.select(*docs.columns))
