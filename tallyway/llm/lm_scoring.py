"""Language-model scores by stupid backoff over count tables of the whole corpus.

    log S(w | context) = log count(context w) - log count(context .)     where count(context w) >= CUTOFF
                       = log BACKOFF + log S(w | shorter context)        otherwise
    log S(w)           = log count(w) - log words

Words are 64-bit hashes, longer contexts a hash of theirs. Each word of a document is exploded into a row (document, word,
contexts). For each order above two the rows are partitioned by the hash of the context, for bigrams by that of the word, so
that a partition holds the counts of its n-grams, and of their contexts or words, next to the rows that ask for them: both
counts are joined to the rows as windows over that one shuffle. Counts of frequent words are broadcast; what needs the count
of another context is joined to the table of words. Scores are summed per document, before and after each shuffle.

Frequent words would make a few partitions hot. Words, contexts and n-grams that would fill more than HOT_SHARE of a
partition of ``width`` are counted first; there are at most width / HOT_SHARE of each by arithmetic, so these tables are broadcast. The rows of a hot
key are partitioned by the n-gram instead, those of a hot n-gram are salted by their place, and both take their counts from
the broadcast tables. Where bigrams are the longest n-grams, frequent ones aren't shuffled at all: their scores are broadcast,
and summed per document where the text is read.

Defined results: a text of no or one word has no term: n_scored 0, log_score 0, mean null. A text's first word has no term. Rows
with a null doc_id are scored together as one document of that id. A document that repeats a doc_id is scored with the others
of that id. A repeated row or text counts as often as it occurs. Other columns don't matter. Hashes of two different words
agree with probability 2**-64 per pair: among 50 million words that any two do has a probability below 1e-4.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, stored
from tallyway.llm.text import word_hashes, words

ORDER = 2
CUTOFF = 2
BACKOFF = 0.4
#: Rows that a partition gets, on average, where the session's shuffle partitions would get more.
PER_PART = 4_000_000
#: Words whose counts, and numbers instead of hashes, every task is told at most, unless partitions are still more.
TOLD = 1_000_000
#: Contexts and n-grams are counted, in search of hot ones, among words with more than one in so many of all words, or hot ones.
COMMON = 200
#: The same in search of frequent bigrams; of these, every task is told those with more than one in TOLD_PAIRS of all words.
COMMON_IN_PAIRS = 30_000
TOLD_PAIRS = 2_000_000
#: What has more than this share of a partition's rows is hot.
HOT_SHARE = 0.25


def context(order: int) -> str:
    """The column with a hash of the ``order - 1`` words before; null where there are fewer."""
    return f"c{order}"


def terms(docs: DataFrame, order: int) -> DataFrame:
    """A row for each word: doc_id, at (its place), w and its contexts of every order."""
    h = F.col("h")
    none = lambda n: F.array(*[F.lit(None).cast("bigint")] * n)
    before = [F.concat(none(j), F.slice(h, 1, F.greatest(F.size("h") - j, F.lit(0)))).alias(f"p{j}") for j in range(1, order)]
    zipped = F.slice(F.arrays_zip(h.alias("w"), *before), 1, F.size("h"))
    coded = docs.select("doc_id", word_hashes(words(F.col("text"))).alias("h"))
    each = coded.select("doc_id", F.posexplode(zipped).alias("at", "x")).select("doc_id", "at", "x.*")
    longer = [F.when(F.col(f"p{k - 1}").isNotNull(), F.xxhash64(*[f"p{j}" for j in range(1, k)])).alias(context(k)) for k in range(3, order + 1)]
    return each.select("doc_id", "at", "w", F.col("p1").alias("c2"), *longer)


def numbered(rows: DataFrame, told: DataFrame, *names: str) -> DataFrame:
    """The hashes of frequent words in columns ``names`` replaced by numbers."""
    for name in names:
        number = F.broadcast(told.select(F.col("word").alias(name), "number"))
        rows = rows.join(number, name, "left").withColumn(name, F.coalesce("number", name)).drop("number")
    return rows


def failed(contexts: list[str]) -> Column:
    """How many of the contexts a row has: it backs off from each."""
    return sum((F.col(c).isNotNull().cast("int") for c in contexts), F.lit(0))


def frequent(rows: DataFrame, c: str, hot: DataFrame, bound: float) -> tuple[DataFrame, DataFrame]:
    """Broadcast tables of the hot contexts ``c`` (with all their rows counted) and of the hot n-grams.

    The last word of a hot context and that of a hot n-gram are hot words themselves, so only those of ``hot`` are looked at.
    """
    last = F.broadcast(hot.select(F.col("number").alias("c2")))
    ends = F.broadcast(hot.select(F.col("number").alias("w"), F.lit(True).alias("often")))
    some = rows.filter(F.col(c).isNotNull()).join(last, "c2", "left_semi").join(ends, "w", "left")
    counted = cut(some.groupBy(c, F.when(F.col("often"), F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n")))
    contexts = counted.groupBy(c).agg(F.sum("n").alias("told_context")).filter(F.col("told_context") > bound)
    return F.broadcast(contexts), hot_grams(counted.filter(F.col("w").isNotNull()), c, bound)


def paired(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id and the numbers c2 and w of each bigram of two words of ``common``."""
    first, second = (F.broadcast(common.select(F.col("word").alias(name), F.col("number").alias(f"{name}_number"))) for name in ("c2", "w"))
    return terms(docs, 2).join(second, "w").join(first, "c2").select("doc_id", F.col("c2_number").alias("c2"), F.col("w_number").alias("w"))


def pair(numbers: int) -> Column:
    """One number for a bigram of words with numbers up to ``numbers``; null for others."""
    both = F.col("c2").between(1, numbers) & F.col("w").between(1, numbers)
    return F.when(both, F.col("c2") * (numbers + 1) + F.col("w"))


def hot_grams(counted: DataFrame, c: str, bound: float) -> DataFrame:
    return F.broadcast(counted.filter(F.col("n") > bound).select(c, "w", F.col("n").alias("told_gram")))


def dealt(rows: DataFrame, keep: list[str], key: str, other: str, hot: DataFrame, grams: DataFrame | None, width: int) -> DataFrame:
    """``rows`` partitioned by ``key``, with the counts of (key, other) and of the key as ``n_gram`` and ``n_key``.

    Keys in ``hot`` are partitioned by ``other`` too, so that ``n_key`` means nothing for them; rows without a key, and
    those of hot n-grams (``grams``; None: there are none), are dealt out by their place, so that neither count means anything for them.
    """
    named = rows.join(hot.withColumn("is_hot", F.lit(True)), key, "left")
    named = with_told(named, grams, key, other)
    place = F.xxhash64("w", "doc_id", "at")
    salt = F.when(F.col(key).isNull() | F.col("told_gram").isNotNull(), place).when(F.col("is_hot"), F.coalesce(other, place))
    # Sorted before the shuffle, equal words stand side by side, and the shuffled blocks compress better.
    out = named.select(*keep, salt.alias("salt")).sortWithinPartitions(key, other).repartition(width, key, "salt")
    out = out.withColumn("n_gram", F.count(F.lit(1)).over(Window.partitionBy(key, "salt", other)))
    return out.withColumn("n_key", F.count(F.lit(1)).over(Window.partitionBy(key, "salt"))).drop("salt")  # on the same sort


def with_told(rows: DataFrame, grams: DataFrame | None, *names: str) -> DataFrame:
    """``rows`` with the counts of hot n-grams as ``told_gram``, null for others."""
    return rows.withColumn("told_gram", F.lit(None).cast("bigint")) if grams is None else rows.join(grams, list(names), "left")


def score(docs: DataFrame, order: int = ORDER, cutoff: int = CUTOFF, backoff: float = BACKOFF) -> DataFrame:
    """One row per doc_id of ``docs`` (doc_id, text): doc_id, n_scored, log_score (natural) and mean_log_score.

    ``order`` is that of the longest n-grams, two or more.
    """
    if order < 2:
        raise ValueError("the order is at least two")
    each = docs.select(words(F.col("text")).alias("x")).select(F.size("x").alias("size"), F.posexplode("x").alias("at", "word"))
    last = F.sum((F.col("at") + 1 == F.col("size")).cast("int"))
    table = each.groupBy(F.xxhash64("word").alias("word")).agg(F.count(F.lit(1)).alias("total"), last.alias("ends"))
    table = stored(table.select("word", "total", (F.col("total") - F.col("ends")).alias("m")), "words")
    tokens = table.agg(F.sum("total")).first()[0] or 0
    width = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // PER_PART))
    bound = HOT_SHARE * tokens / width
    # At most TOLD words are so frequent, or width / HOT_SHARE. Numbers are shorter than hashes where rows are shuffled.
    told = table.filter(F.col("total") > min(tokens / TOLD, bound))
    told = cut(told.select("word", "total", "m", (F.row_number().over(Window.orderBy(F.desc("total"), "word"))).cast("bigint").alias("number")))
    hot = told.filter(F.col("total") > bound)
    common = cut(told.filter(F.col("total") > min(tokens / COMMON_IN_PAIRS, bound)))

    rows = numbered(terms(docs, order), told, "w", "c2")
    contexts = [context(k) for k in range(2, order + 1)]
    step = F.lit(math.log(backoff))
    for k in range(order, 2, -1):
        c = context(k)
        heavy, grams = frequent(rows, c, common.filter(F.col("total") > min(tokens / COMMON, bound)), bound)
        met = dealt(rows, rows.columns, c, "w", heavy.select(c), grams, width).join(heavy, c, "left").join(grams, [c, "w"], "left")
        n, m = F.coalesce("told_gram", "n_gram"), F.coalesce("told_context", "n_key")
        own = F.when(F.col(c).isNotNull() & (n >= cutoff), F.log(n) - F.log(m) + step * failed(contexts[k - 1 :]))
        value = own if k == order else F.coalesce("value", own)
        rows = met.select("doc_id", "at", "w", *contexts, value.alias("value"))

    # Bigrams are partitioned by their second word, whose own count is then at hand. The counts of frequent words are told to
    # every task; what needs that of another first word keeps asking for it, the rest is summed by document at once.
    log_tokens = math.log(max(tokens, 1))
    pairs = paired(docs, common)
    counted = pairs.groupBy("c2", "w").agg(F.count(F.lit(1)).alias("n"))
    at_once = None
    if order == 2:
        grams, numbers = None, common.agg(F.max("number")).first()[0] or 0
        known = counted.filter(F.col("n") > min(tokens / TOLD_PAIRS, bound))
        for name, count in (("c2", "m"), ("w", "total")):
            known = known.join(F.broadcast(common.select(F.col("number").alias(name), count)), name)
        worth = F.when(F.col("n") >= cutoff, F.log("n") - F.log("m")).otherwise(F.log("total") - log_tokens + step)
        known = cut(known.select(pair(numbers).alias("pair"), worth.alias("value")))
        scored = pairs.select("doc_id", pair(numbers).alias("pair")).join(F.broadcast(known), "pair")
        at_once = scored.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_scored"), F.sum("value").alias("log_score"))
        rows = rows.withColumn("pair", pair(numbers)).join(F.broadcast(known.select("pair")), "pair", "left_anti").drop("pair")
    else:
        grams = hot_grams(cut(counted.filter(F.col("n") > bound)), "c2", bound)
    keep = [x for x in rows.columns if x != "at"]
    met = dealt(rows, keep, "w", "c2", F.broadcast(hot.select(F.col("number").alias("w"))), grams, width).filter(F.col("c2").isNotNull())
    met = with_told(met, grams, "c2", "w").join(F.broadcast(told.select(F.col("number").alias("w"), "total")), "w", "left")
    met = met.join(F.broadcast(told.select(F.col("number").alias("c2"), "m")), "c2", "left")
    n = F.coalesce("told_gram", "n_gram")
    backed = F.log(F.coalesce("total", "n_key")) - log_tokens + step
    own = F.when(n >= cutoff, F.log(n) - F.coalesce(F.log("m"), F.lit(0.0))).otherwise(backed) + step * failed(contexts[1:])
    value, asks = (own, F.lit(True)) if order == 2 else (F.coalesce("value", own), F.col("value").isNull())
    word = F.when(asks & (n >= cutoff) & F.col("m").isNull(), F.col("c2"))
    # Asking rows are told apart by a count below zero and joined from the left (the table has every word), so that no filter
    # on the word is pushed below the grouping: both branches read one shuffle.
    counts = [F.sum("value").alias("value"), F.sum(F.when(F.col("word").isNull(), 1).otherwise(-1)).alias("n")]
    sums = met.select("doc_id", word.alias("word"), value.alias("value")).groupBy("doc_id", "word").agg(*counts)
    asked = table.filter(F.col("m") >= cutoff).select("word", "m")
    rare = sums.filter("n < 0").join(asked, "word", "left").select("doc_id", (F.col("value") + F.col("n") * F.log("m")).alias("value"), -F.col("n"))
    parts = sums.filter("n > 0").select("doc_id", "value", "n").union(rare).select("doc_id", F.col("n").alias("n_scored"), F.col("value").alias("log_score"))
    if at_once is not None:
        parts = parts.union(at_once)
    none = docs.select("doc_id", F.lit(0).cast("bigint").alias("n_scored"), F.lit(0.0).alias("log_score"))
    total = parts.union(none).groupBy("doc_id").agg(F.sum("n_scored").alias("n_scored"), F.sum("log_score").alias("log_score"))
    return total.withColumn("mean_log_score", F.when(F.col("n_scored") > 0, F.col("log_score") / F.col("n_scored")))
