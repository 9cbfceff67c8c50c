"""What the check of op3_packing asked for: words and islands that are handled as arrays, not one by one."""

import itertools
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tallyway.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_are_cut_by_kinds_of_bytes_as_by_the_pattern():
    """Every text of up to five of these letters, and longer ones by chance; texts of other letters lie between them and keep their places."""
    letters = ["a", "s", "r", "e", "'", " ", "\n", "1", "."]
    texts = ["".join(x) for n in range(5) for x in itertools.product(letters, repeat=n)]
    rng = random.Random(6)
    more = [*letters, "l", "v", "d", "S", "é", "ɏ", "\x00", "\t", "'ll", "'ve", "×", "中", "\x1f", "\x7f", "\xa0", "<|endoftext|>"]
    texts += ["".join(rng.choice(more[: len(more) - 6 * (k % 2)]) for _ in range(rng.randrange(25))) for k in range(5000)]
    for text in texts:
        if not bpe.BEYOND.search(text):
            data = np.frombuffer((text + bpe.WHOLE).encode(), np.uint8)
            cut = [x.tobytes().decode() for x in np.split(data, bpe.word_starts(data)[1:])]
            assert cut == [*bpe.WORDS.findall(text), bpe.WHOLE], text
    want = [[*x.ids, 0] for x in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encoded(texts, PATH, 0)] == want
    assert [x.tolist() for x in bpe.encoded(["", None, "中", None], PATH, 0)][:2] == [[0], [0]]


def test_a_word_is_looked_up_once_in_many_texts():
    asked = []

    class Told(bpe.Numbers):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    encoder = bpe.Encoder(PATH)
    encoder.known = Told()
    ids, sizes = encoder.encode(["some words and some more words"] * 1000)
    assert len(ids) == sizes.sum() == 1000 * sizes[0] and len(asked) <= 10


def test_an_island_is_written_as_arrays():
    """The row is the one that single numbers gave, without the half second that they took."""
    lengths = np.random.default_rng(1).integers(1, 1024, packing.SHARD)
    group, rids = packing.founders(lengths, 1, 1024), np.arange(len(lengths)) * 3
    values = {"shard": 5, "island": 2, "rids": rids, "lengths": lengths.astype(np.int32), "population": [b.astype(np.int32) for b in group]}
    began = time.process_time()
    made = packing.state_row(5, 2, rids, lengths, group)
    assert time.process_time() - began < 0.1
    assert made.equals(pa.RecordBatch.from_pylist([values], packing.STATE_ARROW))


def test_islands_come_back_from_an_epoch(spark):
    """Two epochs by way of Spark: the same islands with packings of all their pieces, none worse than before."""
    rows = [(s, i, list(range(s * 100, s * 100 + 60)), [1 + (37 * k * (s + 1)) % 1000 for k in range(60)]) for s in range(2) for i in range(packing.ISLANDS)]
    begun = spark.createDataFrame(rows, "shard long, island int, rids array<long>, lengths array<int>")
    first = packing.breed(begun, 0, 1024).localCheckpoint()
    second = {(r["shard"], r["island"]): r for r in packing.breed(packing.migrate(first), 1, 1024).collect()}
    assert len(second) == len(rows)
    for r in first.collect():
        then = second[r["shard"], r["island"]]
        assert (then["rids"], then["lengths"]) == (r["rids"], r["lengths"]) and len(then["population"]) == packing.POPULATION
        for bins in then["population"]:
            assert packing.loads_of(np.array(r["lengths"]), np.array(bins)).max() <= 1024 and len(bins) == 60
        assert max(then["population"][0]) <= max(r["population"][0])
