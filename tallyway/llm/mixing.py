"""Mixing sources to target weights by a temperature.

A source's weight is its share of all tokens to the power of an exponent in [0, 1]: 1 keeps the natural mix, 0 makes
sources equal. The exponent is bisected: the largest whose weights reach a target entropy, and the smallest that
repeats no source more than a limit. The weights times a token budget give each source a number of epochs, whole or
not, which is realised in blocks: a source's documents are dealt into blocks by a hash of doc_id, each block gets a place
in the source's own permutation, whole epochs take all blocks and the last one takes the first blocks of the permutation
until the budget is met. Only (source, block) sums are ever put in order, so a source with most of the rows is summed
before it is shuffled and no group grows with it.

Defined results: a null source counts as ''. A null text has no tokens; sources without tokens keep one epoch. Rows
without a doc_id share a block of their source; repeated rows share a block too. No rows give no rows. Other columns
stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, fresh, small
from tallyway.llm.text import words

#: Blocks of a source; a budget is met to within one of them.
BLOCKS = 1024
#: Halvings of the exponent's interval, so many of them per aggregation.
HALVINGS, AT_ONCE = 24, 4


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for.

    entropy: as a share of the entropy of equal weights. repetition: epochs of any source at most. tokens: the budget;
    None takes the least that uses every document once.
    """

    entropy: float | None = None
    repetition: float | None = None
    tokens: int | None = None


def number(text: str) -> str:
    """SQL: a number below 2**32 from a string, the same in any engine."""
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def counted(docs: DataFrame, source: str = "source") -> DataFrame:
    """Each row's source, block and tokens, with doc_id."""
    of = F.coalesce(F.col(source), F.lit(""))
    block = F.expr(number("coalesce(CAST(doc_id AS STRING), '')") + f" % {BLOCKS}")
    return docs.select("doc_id", of.alias("source"), block.alias("block"), F.size(words(F.col("text"))).cast("bigint").alias("n_tokens"))


def sums(rows: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: the sum of s**a over sources with share s, and of s**a * a * ln s."""
    made = [F.sum(F.exp(a * F.col("l"))).alias(f"z{i}") for i, a in enumerate(exponents)]
    made += [F.sum(F.exp(a * F.col("l")) * a * F.col("l")).alias(f"e{i}") for i, a in enumerate(exponents)]
    row = rows.agg(*made).first()
    return [(row[f"z{i}"], row[f"e{i}"]) for i in range(len(exponents))]


def exponent(shares: DataFrame, target: Target) -> float:
    """Bisects the exponent over ``shares(source, tokens)``; the driver sees sums only, however many sources there are."""
    told = shares.filter("tokens > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("total"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if not told["n"]:
        return 1.0
    rows = shares.filter("tokens > 0").select(F.log(F.col("tokens") / F.lit(float(told["total"]))).alias("l"))
    least, most = (math.log(told[k] / told["total"]) for k in ("least", "most"))

    def even_enough(a: float, z: float, e: float) -> bool:
        return target.entropy is None or math.log(z) - e / z >= target.entropy * math.log(told["n"])

    def too_often(a: float, z: float, e: float) -> bool:
        if target.repetition is None:
            return False
        budget = target.tokens if target.tokens is not None else told["most"] * z / math.exp(a * most)
        return budget * math.exp(a * least) / z / told["least"] > target.repetition

    def bisected(goes_up) -> float:
        """The end of the exponents from 0 on at which ``goes_up`` holds."""
        lo, hi = 0.0, 1.0
        if goes_up(1.0, *sums(rows, [1.0])[0]):
            return 1.0
        for _ in range(HALVINGS // AT_ONCE):
            steps = 2**AT_ONCE
            grid = [lo + (hi - lo) * k / steps for k in range(1, steps)]
            up = [goes_up(a, z, e) for a, (z, e) in zip(grid, sums(rows, grid), strict=True)]
            k = 0
            for half in (steps // 2**j for j in range(1, AT_ONCE + 1)):
                k += half * up[k + half - 1]
            lo, hi = lo + (hi - lo) * k / steps, lo + (hi - lo) * (k + 1) / steps
        return lo

    a = bisected(even_enough) if target.entropy is not None else (0.0 if target.repetition is not None else 1.0)
    return max(a, bisected(too_often)) if target.repetition is not None else a


def weighted(shares: DataFrame, target: Target) -> DataFrame:
    """source, tokens, weight and epochs."""
    shares = cut(shares)
    a = exponent(shares, target)
    raw = shares.filter("tokens > 0").select("source", "tokens", F.pow(F.col("tokens").cast("double"), F.lit(a)).alias("p"))
    z, stretch = raw.agg(F.sum("p").alias("z"), F.max(F.col("tokens") / F.col("p")).alias("stretch")).first()
    budget = float(target.tokens) if target.tokens is not None else (stretch or 0.0) * (z or 0.0)
    share = F.col("p") / F.lit(z)
    out = raw.select("source", "tokens", share.alias("weight"), (F.lit(budget) * share / F.col("tokens")).alias("epochs"))
    idle = shares.filter("tokens = 0").select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(1.0).alias("epochs"))
    return cut(out.union(idle))


def planned(rows: DataFrame, target: Target) -> DataFrame:
    """For each (source, block): copies to take, place in the permutation, and the source's epochs and weight."""
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")))
    sources = weighted(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), target)
    place = F.expr(number("concat(source, ':', CAST(block AS STRING))"))
    order = Window.partitionBy("source").orderBy("place", "block")
    placed = blocks.withColumn("place", place).select(
        "source", "block", "tokens",
        (F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("before"),
        ((F.row_number().over(order) - 0.5) / F.count(F.lit(1)).over(Window.partitionBy("source"))).alias("place"),
    )
    joined = placed.join(small(sources.withColumnRenamed("tokens", "source_tokens")), "source")
    whole = F.floor(F.round("epochs", 6))
    rest = (F.round("epochs", 6) - whole) * F.col("source_tokens")
    copies = whole + F.when(F.col("before") + F.col("tokens") / 2.0 < rest, 1).otherwise(0)
    return joined.select("source", "block", copies.cast("int").alias("copies"), "place", "weight", "epochs")


def mixed(docs: DataFrame, target: Target, source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, n_tokens, copies (0 and more), place of its block in (0, 1), weight, epochs."""
    rows = cut(counted(docs, source))
    return rows.join(small(cut(planned(rows, target))), ["source", "block"]).select("doc_id", "source", "n_tokens", "copies", "place", "weight", "epochs")


def realised(docs: DataFrame, target: Target, source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all columns and ``mix_order`` in [0, 1).

    Read in that order, every stretch has the sources in their weights and each source its blocks in permuted order.
    """
    plan = small(cut(planned(cut(counted(docs, source)), target))).select(
        F.col("source").alias("mix_source"), F.col("block").alias("mix_block"), F.col("copies").alias("mix_copies"), F.col("place").alias("mix_place"), F.col("epochs").alias("mix_epochs")
    )
    row = fresh(docs, "row")
    of = F.coalesce(F.col(f"{row}.{source}"), F.lit(""))
    block = F.expr(number(f"coalesce(CAST({row}.doc_id AS STRING), '')") + f" % {BLOCKS}")
    rows = docs.select(F.struct("*").alias(row)).withColumn("mix_source", of).withColumn("mix_block", block)
    taken = rows.join(plan, ["mix_source", "mix_block"]).filter("mix_copies > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), "mix_copies")))
    at = (F.col("mix_copy") - 1 + F.col("mix_place")) / F.greatest(F.col("mix_epochs"), F.col("mix_copies"))
    return taken.withColumn(fresh(docs, "mix_order"), at).select(f"{row}.*", fresh(docs, "mix_order"))
