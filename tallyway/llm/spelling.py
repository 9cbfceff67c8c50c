"""Groups of spelling variants: words one edit apart, found by asymmetric chunks, and the frequent form that each rare one stands for.

Of two words one gives two disjoint chunks, its halves, and the other positional grams of the same lengths. One edit touches one half, so the other
half stands in the longer word where it stood, or one place later if the edit before it added a letter. The shorter word (either, at equal length)
gives its halves with its length; every word gives the grams that a word of its own length or one letter shorter would need, at the place that
the shift allows, so that a join on length, half and letters finds all pairs. Candidates are verified.

A half that many words share would make too many candidates. Such a group is split by the same argument again: the edit lies in what
isn't shared yet, so one half of that is preserved too, and both halves become keys together with the part that is shared already.
Candidates of groups that are paired are at most SPLIT for each row, whatever the data, until all is shared but one letter; such a group is no
larger than the alphabet allows.

Defined results: null and empty texts have no words. A null doc_id counts as an empty string where variants are made. Rows that repeat a doc_id or
a text count each. Letters outside A-Z and U+00C0 to U+00FF end a word. Other columns don't matter, an empty table gives no rows.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, let, small, stored

#: Code points and occurrences of a word at least.
LETTERS, OCCURRENCES = 7, 2
#: One run in so many of a document loses a letter; how many times more frequent a form is than the word.
EVERY, TIMES = 31, 10
#: Candidates for each row of a group that is paired; beyond, the group is split.
SPLIT = 64
RUN = rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}"


def varied(doc_id: Column, word: Column) -> Column:
    """``word`` less the letter that the checksum of doc_id and word names, where EVERY divides it."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return let(checksum, lambda h: F.when(h % EVERY == 0, let(h % F.char_length(word), lambda at: F.concat(F.substr(word, F.lit(1), at.cast("int")), F.substr(word, (at + 2).cast("int"))))).otherwise(word))


def words_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word and n of all words of LETTERS code points and OCCURRENCES at least; runs that are shorter can't give one."""
    lower = lambda w: F.translate(w, string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.col(key).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run")).select("doc_id", lower(F.col("run")).alias("run"))
    words = runs.select(varied(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)


def part(start: Column | str, length: Column | str) -> Column:
    """Letters of the word from a place on (from 0)."""
    start, length = (F.col(x) if isinstance(x, str) else x for x in (start, length))
    return F.substr("word", (start + 1).cast("int"), length.cast("int"))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, size, chunk, head, tail, least) with the key of their group.

    size: letters of the pair's shorter word; chunk: whether the row gives its chunks, or grams; head and tail: letters that the pair shares at its ends;
    least: letters in which they don't agree from the start on, or 0, which tells that they weren't found by an earlier key.
    """
    tail = part(F.char_length("word") - F.col("tail"), F.col("tail"))
    return rows.withColumn("key", F.xxhash64("size", "head", "tail", "least", part(F.lit(0), "head"), tail))


def halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the first half of what isn't shared is shared too, or the second."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("least").alias("least"))
    least = F.when(F.col("least") == 0, F.col("head") + half).otherwise(F.least(F.col("least"), F.col("head") + half))
    second = F.struct(F.col("head").alias("head"), (F.col("size") - F.col("head") - half).alias("tail"), least.alias("least"))
    return rows.select("word", "n", "size", "chunk", F.explode(F.array(first, second)).alias("x")).select("word", "n", "size", "chunk", "x.head", "x.tail", "x.least")


def roles(words: DataFrame) -> DataFrame:
    """A word as the one that gives chunks, and as one that gives grams for a word of its own length or a letter shorter."""
    length = F.char_length("word")
    role = lambda size, chunk: F.struct(size.cast("int").alias("size"), F.lit(chunk).alias("chunk"))
    each = words.select("word", "n", F.explode(F.array(role(length, True), role(length, False), role(length - 1, False))).alias("r"))
    none = F.lit(0)
    return each.select("word", "n", "r.size", "r.chunk", none.alias("head"), none.alias("tail"), none.alias("least")).filter(F.col("size") >= LETTERS)


def paired(rows: DataFrame) -> DataFrame:
    """word, n, other, other_n of the pairs of each group that are one edit apart, once."""
    chunks = rows.filter("chunk").drop("chunk")
    grams = rows.filter("NOT chunk").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("size").alias("size_"), F.col("head").alias("head_"), F.col("tail").alias("tail_"))
    both = chunks.join(grams, "key").filter("size = size_ AND head = head_ AND tail = tail_ AND (char_length(other) > size OR word < other)")
    ends = "substr(word, 1, head) = substr(other, 1, head) AND right(word, tail) = right(other, tail)"
    return both.filter(f"{ends} AND (least = 0 OR substr(word, 1, least) != substr(other, 1, least))").filter("levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n")


def near(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, n, other, other_n: every pair of ``words`` one edit apart, once, the shorter or smaller one first."""
    rows, found = keyed(halved(roles(words))), []
    while True:
        tally = rows.groupBy("key").agg(F.count_if("chunk").alias("c"), F.count_if(~F.col("chunk")).alias("g"), F.min(F.col("size") - F.col("head") - F.col("tail")).alias("open"))
        large = tally.filter((F.col("c") * F.col("g") > split * (F.col("c") + F.col("g"))) & (F.col("open") > 1)).select("key")
        large = cut(large)
        hot = small(large)
        found.append(stored(paired(rows.join(hot, "key", "left_anti")), "near"))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = stored(keyed(halved(rows.join(hot, "key", "left_semi"))), "split")


def roots(forms: DataFrame) -> DataFrame:
    """word and root from word and form: forms are followed by doubling; each is more frequent than its word, so they end."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = cut(now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", "root", "next"))
        now = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.filter("next IS NOT NULL").isEmpty():
            return now


def spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    form: the near word of largest n (of equal ones the smallest), if it is at least TIMES as frequent; root: the last of the forms of forms, or the word.
    """
    words = stored(words_of(docs), "words")
    pairs = near(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("best"), F.first("n").alias("n"))
    enough = -F.col("best.minus") >= TIMES * F.col("n")
    about = stored(best.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")), "forms")
    out = words.join(about, "word", "left").join(roots(about.filter("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
