"""Alignment of two tokenizers over the same texts: groups of tokens between common ends, and how widely each linked id pair occurs.

Texts are encoded by a byte-level BPE (A) and a sentencepiece model (B). From there on a batch of documents is Arrow lists: flattened ids with
the parent index of each, byte lengths of ids summed up by document, and a document-end key, the document's number above the byte where the
token ends. One full outer hash join of Acero on that key gives the union of both tokenizers' ends: an end with a token on either side ends a
group, and of any two neighbouring ends exactly one token of A and one of B cover what lies between, so filling nulls from behind
gives all links. Links are counted by document and pair with ``Table.group_by``, documents by pair likewise for the whole task; Spark
merges those partial counts, and joins them back to the documents' own pairs.

Both encoders cut texts before white space that follows something else, so each distinct chunk is encoded once per worker while it is remembered;
a text that a tokenizer may see otherwise is encoded whole.

Defined results: null and empty texts, and those whose tokens don't spell a space and the text, have no tokens, zeros, and '' for
the groups. Rows that repeat a doc_id each give a row and count as documents of their own; a null doc_id stays null. Other columns don't
matter, an empty table gives no rows. A text is held in memory whole, by one worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyway.llm.bpe import ODD, byte_letters, grouped
from tallyway.llm.tables import BROADCAST_BYTES, small, stored

#: Distinct chunks that one worker remembers, and letters of them at most; beyond, it forgets the rare half.
KNOWN, LETTERS = 250_000, 5_000_000
#: Distinct pairs of a task's partial counts before they go out.
PAIRS = 1_000_000
#: Pairs of more documents than a share of all rows, at most so many, are broadcast whatever the size of the pair table.
HOT = 100_000
SPACE = "▁"
#: Texts that a sentencepiece model must treat alike in whole and in chunks.
PROBES = ("a  b", "x \n y\tz", "a;\r\n\r\n b;\r", "ﬁ Ｘ é é", "1 2  3\n\n4", "a b c", "q ")


def chunk_pattern(glued: set[str]) -> re.Pattern[str]:
    """White space and what follows it, up to white space that no token joins to what stands before it; a text with a space before it is a sequence of these."""
    more = f"(?:[{re.escape(''.join(sorted(glued)))}]\\s*\\S*)*" if glued else ""
    return re.compile(rf"\s+\S*{more}")


class Lists:
    """Lists of ids one after the other, in arrays that grow."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), self.n + len(sizes)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        if n > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(max(len(x), len(sizes)), np.int64)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + total] = ids
        self.start[self.n : n], self.size[self.n : n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used, self.n = self.used + total, n

    def flat(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these lists one after the other, and where each ends."""
        size = self.size[where]
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.start[where] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)], stop

    def keep(self, where: np.ndarray) -> None:
        ids, stop = self.flat(where)
        size = self.size[where]
        self.ids, self.used, self.start, self.size, self.n = ids, len(ids), stop - size, size, len(where)


class Pair:
    """Both tokenizers of a worker, and the chunks it remembers."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        value = {c: b for b, c in byte_letters().items()}
        told = self.a.get_vocab()
        entries: list[bytes] = [b""] * (max(told.values(), default=-1) + 1)
        for entry, k in told.items():
            entries[k] = bytes(value[c] for c in entry) if all(c in value for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.bytes = tuple(pa.array(x, pa.binary()) for x in (entries, spelt))
        self.lengths = tuple(pc.binary_length(x).cast(pa.int64()) for x in self.bytes)
        self.sizes = tuple(x.to_numpy() for x in self.lengths)
        self.decimals = pa.array([str(k) for k in range(max(len(entries), len(spelt)))], pa.string())
        self.bits = max(1, (len(spelt) - 1).bit_length())
        glued = {y for p in pieces for x, y in zip(p, p[1:]) if x != SPACE and not x.isspace() and (y == SPACE or y.isspace())}
        self.chunk = chunk_pattern(glued - {SPACE})
        self.chunks = SPACE not in glued and self.cuts_a() and self.cuts_b()
        self.known: dict[str, int] = {}
        self.lists, self.hits, self.held = (Lists(), Lists()), np.zeros(0, np.int64), 0

    def cuts_a(self) -> bool:
        """Whether A's pre-tokenizer is the byte-level pattern, which cuts before white space."""
        pre = self.a.pre_tokenizer
        told = json.loads(pre.__getstate__()) if pre is not None else {}
        return bool(told.get("type") == "ByteLevel" and told.get("use_regex") and not told.get("add_prefix_space") and self.a.normalizer is None)

    def cuts_b(self) -> bool:
        """Whether texts come out of B alike in whole and in chunks."""
        parts = lambda t: chain.from_iterable(map(self.chunk_b, self.chunk.findall(" " + t)))
        return len(self.b.encode("a")) == 1 and all(self.b.encode(t) == list(parts(t)) for t in PROBES)

    def chunk_b(self, chunk: str) -> list[int]:
        """B's ids of a chunk; the letter before it takes the space that the model adds."""
        return self.b.encode("a" + chunk)[1:]

    def forget(self) -> None:
        often = np.argsort(-self.hits, kind="stable")[: KNOWN // 2]
        keep = np.sort(often[self.hits[often] > 1])
        words = list(self.known)
        words = [words[i] for i in keep.tolist()]
        self.held = sum(map(len, words))
        if self.held > LETTERS // 2:
            keep, words, self.held = keep[:0], [], 0
        self.known = dict(zip(words, range(len(words)), strict=True))
        self.hits = self.hits[keep] // 2
        for x in self.lists:
            x.keep(keep)

    def learn(self, new: list[str]) -> None:
        """Encodes what isn't known; a text that isn't cut is kept like a chunk."""
        n = len(self.known)
        whole = [lambda t: self.a.encode(t, add_special_tokens=False).ids, self.chunk_b if self.chunks else lambda t: self.b.encode(t[1:])]
        for lists, encode, lengths in zip(self.lists, whole, self.sizes, strict=True):
            for some in slices(new):
                lists.add(*at_once(some, encode, lengths) if self.chunks else singly(some, encode))
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.held += sum(map(len, new))
        self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def encode(self, texts: Sequence[str]) -> tuple[pa.LargeListArray, pa.LargeListArray]:
        """The lists of A's and B's ids of these texts (each with its space before it); empty texts have none."""
        if len(self.known) > KNOWN or self.held > LETTERS:
            self.forget()
        cut = [self.chunk.findall(t) if self.chunks and not ODD.search(t) else [t] for t in texts]
        words = list(chain.from_iterable(cut))
        where = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(where < 0)
        if len(missing):
            unknown = [words[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(unknown)))
            where[missing] = list(map(self.known.__getitem__, unknown))
        self.hits += np.bincount(where, minlength=len(self.known))
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        out = []
        for x in self.lists:
            ids, stop = x.flat(where)
            out.append(pa.LargeListArray.from_arrays(np.concatenate([[0], stop])[bounds], ids))
        return out[0], out[1]


def slices(chunks: list[str], most: int = 100_000) -> Iterator[list[str]]:
    """Neighbouring chunks of ``most`` characters, or one longer one."""
    stop = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks))) // most
    for first, last in zip(edges := [0, *(np.flatnonzero(np.diff(stop)) + 1).tolist(), len(chunks)], edges[1:]):
        yield chunks[first:last]


def singly(chunks: list[str], encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
    made = [encode(c) for c in chunks]
    sizes = np.fromiter(map(len, made), np.int64, len(made))
    return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes


def at_once(chunks: list[str], encode: Callable[[str], list[int]], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chunks and how many each has, from one call for all; singly, if tokens don't end where chunks do."""
    ids = np.array(encode("".join(chunks)), np.uint32)
    stop, want = np.cumsum(lengths[ids]), np.cumsum(np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in chunks), np.int64, len(chunks)))
    at = np.searchsorted(stop, want)
    if len(ids) == 0 or at[-1] != len(ids) - 1 or (stop[at] != want).any() or any(c[-1].isspace() for c in chunks):
        return singly(chunks, encode)
    return ids, np.diff(at, prepend=-1)


_pairs: dict[tuple[str, str], Pair] = {}


def pair(byte_bpe: str, piece_bpe: str) -> Pair:
    """The worker's tokenizers; what they have learnt serves later tasks."""
    if (byte_bpe, piece_bpe) not in _pairs:
        _pairs[byte_bpe, piece_bpe] = Pair(byte_bpe, piece_bpe)
    return _pairs[byte_bpe, piece_bpe]


def spells(lists: pa.LargeListArray, entries: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Which lists' joined entries are the bytes of their text."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(lists.offsets, entries.take(pc.list_flatten(lists))), b"")
    return pc.equal(joined.cast(pa.large_binary()), pa.array(texts, pa.large_binary())).to_numpy(zero_copy_only=False)


def emptied(lists: pa.LargeListArray, good: np.ndarray) -> pa.LargeListArray:
    """The lists with those that aren't good empty."""
    kept = pc.list_flatten(lists).filter(pa.array(good).take(pc.list_parent_indices(lists)))
    sizes = np.where(good, pc.list_value_length(lists).to_numpy(), 0)
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), kept)


def ends(lists: pa.LargeListArray, lengths: pa.Array, side: str) -> pa.Table:
    """Document-end key and place in the flattened lists of each token; the end is the sum of the document's lengths so far."""
    ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(lengths.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets.slice(0, len(lists)))
    end = pc.subtract(total, before.take(parent))
    key = pc.bit_wise_or(pc.shift_left(parent.cast(pa.int64()), 40), end)
    return pa.table({"end": key, side: pa.array(np.arange(len(ids), dtype=np.int64))})


def joined(lists: pa.LargeListArray, of: pa.Array, by: str) -> pa.Array:
    return pc.binary_join(pa.LargeListArray.from_arrays(lists, of), by)


def linked(a: pa.LargeListArray, b: pa.LargeListArray, pair: Pair) -> tuple[pa.Table, pa.Table]:
    """By document: n_groups, n_links and the groups as text; and doc, pair, times of each linked id pair of a document."""
    both = ends(a, pair.lengths[0], "a").join(ends(b, pair.lengths[1], "b"), "end", join_type="full outer", use_threads=False).combine_chunks()
    both = both.take(pc.sort_indices(both["end"]))
    doc = pc.shift_right(both["end"], 40).combine_chunks()
    closing = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    flat_a, flat_b = pc.list_flatten(a), pc.list_flatten(b)
    # links
    one, two = (pc.fill_null_backward(both[c].combine_chunks()) for c in ("a", "b"))
    key = pc.bit_wise_or(pc.shift_left(flat_a.take(one).cast(pa.int64()), pair.bits), flat_b.take(two).cast(pa.int64()))
    links = pa.table({"doc": doc, "pair": key}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    # groups
    at = both.filter(closing)
    stops = [pa.concat_arrays([pa.array([0], pa.int64()), pc.add(at[c].combine_chunks(), 1)]) for c in ("a", "b")]
    spelt = [joined(s, pair.decimals.take(x), ",") for s, x in zip(stops, (flat_a, flat_b), strict=True)]
    group = pc.binary_join_element_wise(*spelt, "|")
    n_groups = np.bincount(doc.filter(closing.combine_chunks()).to_numpy(), minlength=len(a))
    n_links = np.bincount(doc.to_numpy(), minlength=len(a))
    text = joined(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int64()), group, ";")
    return pa.table({"n_groups": n_groups, "n_links": n_links, "groups": text}), links.rename_columns(["doc", "pair", "times"])


def aligned(texts: list[str], pair: Pair) -> tuple[pa.Table, pa.Table]:
    """For texts without their space: n_a, n_b, n_groups, n_links, groups_sha256, and their linked pairs as of ``linked``."""
    spaced = [" " + t if t else "" for t in texts]
    a, b = pair.encode(spaced)
    raw = [t.encode("utf-8", "surrogatepass") for t in spaced]
    good = spells(a, pair.bytes[0], raw) & spells(b, pair.bytes[1], raw) & np.array([bool(t) for t in texts], bool)
    if not good.all():
        a, b = (emptied(x, good) for x in (a, b))
    about, links = linked(a, b, pair)
    shas = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in about["groups"].to_pylist()]
    counts = {f"n_{c}": pc.list_value_length(x) for c, x in (("a", a), ("b", b))}
    return pa.table(counts | {"n_groups": about["n_groups"], "n_links": about["n_links"], "groups_sha256": pa.array(shas, pa.string())}), links


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
LISTS = pa.list_(pa.int64())


def partial(counts: list[pa.Table]) -> pa.Table:
    """Counts by pair of these tables' pairs and docs together."""
    return pa.concat_tables(counts).combine_chunks().group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])


def batch_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c == "groups_sha256" else LISTS if c in ("pairs", "times") else pa.int64()) for c in SCHEMA.replace(",", "").split()[::2]])
    yield from rows.select(schema.names).cast(schema).combine_chunks().to_batches()


def told(counts: pa.Table) -> Iterator[pa.RecordBatch]:
    """Partial counts as rows without a number, whose lists are pairs and documents."""
    for first in range(0, len(counts), 1 << 16):
        part = counts.slice(first, 1 << 16)
        lists = {c: pa.array([part[of].to_numpy()], LISTS) for c, of in (("pairs", "pair"), ("times", "docs"))}
        yield from batch_of(pa.table({c: pa.nulls(1) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")} | lists))


def links_of(docs: DataFrame, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """A row per document with its counts, its linked pairs and their times; and rows without a row number that hold a task's counts of documents by pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, counts, held = pair(byte_bpe, piece_bpe), [], 0
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, first = batch.column("doc_id"), 0
            for texts in grouped(batch.column("text")):
                about, links = aligned(texts, both)
                n = len(texts)
                links = links.take(pc.sort_indices(links["doc"]))
                stop = np.concatenate([[0], np.cumsum(np.bincount(links["doc"].to_numpy(), minlength=n))]).astype(np.int32)
                lists = {c: pa.ListArray.from_arrays(stop, links[of].combine_chunks().cast(pa.int64())) for c, of in (("pairs", "pair"), ("times", "times"))}
                numbers = {"row": pa.array(np.arange(row, row + n)), "doc_id": ids.slice(first, n)}
                yield from batch_of(pa.table(numbers | {c: about[c] for c in about.column_names} | lists))
                counts.append(links.select(["pair"]).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"]))
                held += len(counts[-1])
                if held > PAIRS:
                    counts = [partial(counts)]
                    held = len(counts[0])
                    if held > PAIRS // 2:
                        yield from told(counts[0])
                        counts, held = [], 0
                row, first = row + n, first + n
        if counts:
            yield from told(partial(counts))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def alignment(docs: DataFrame, byte_bpe: str, piece_bpe: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    A pair's count is the number of documents that hold it linked; n_best counts links whose count is the highest of their A id, count_sum adds
    the counts of all links. The pair table is broadcast if its measured size allows; beyond, only its hot rows are, whose number arithmetic
    bounds, and the others, of few documents each, are joined by a shuffle.
    """
    bits = Pair(byte_bpe, piece_bpe).bits
    rows = stored(links_of(docs, byte_bpe, piece_bpe), "links")
    parts = rows.filter("row IS NULL").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = parts.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("docs"))
    most = counts.groupBy(F.shiftright("pair", bits).alias("a")).agg(F.max("docs").alias("most"))
    table = stored(
        counts.withColumn("a", F.shiftright("pair", bits)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best")), "pairs"
    )
    held = rows.filter("row IS NOT NULL")
    own = held.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = small(table, broadcast_bytes)
    if known is not table:
        scored = own.join(known, "pair")
    else:
        total = table.agg(F.sum("docs").alias("n")).first()["n"]
        hot = table.filter(F.col("docs") * HOT > total)
        scored = own.join(F.broadcast(hot), "pair").unionByName(
            own.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(table.filter(F.col("docs") * HOT <= total), "pair")
        )
    sums = scored.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return held.drop("pairs", "times").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
