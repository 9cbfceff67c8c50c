"""Quality rules combined by weak supervision.

Each rule looks at one document and votes bad (-1), good (+1) or abstains (0). How far a vote can be believed is
not set by hand: expectation-maximisation over the counts of vote patterns estimates, for each rule, how often it
votes either way on good and on bad documents, and a document's posterior probability of being good replaces the
usual "must pass every rule".

All work on rows is DataFrame expressions without a shuffle of texts. The counts of vote patterns are one
aggregation; there are at most 3**len(RULES) of them whatever the input, so the driver fits the model on them.

Defined results: a null or blank text has no words, fails the base test and isn't kept. Repeated rows and equal
texts get the same verdict each. Without rows the prior parameters are used. Other columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, fresh, let, stored
from tallyway.llm.text import stripped_of, whole, window_hashes, word_hashes, words

SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 5


def repeated_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words that lie in a run of ``n`` words found twice or more in the text, the first time included.

    Few texts repeat any run: a set of the runs tells them, and only the others pay for the sort that brings equal
    runs together. Of the sorted starts of repeated runs each covers ``n`` words, or up to the next start.
    """

    def covered(runs: Column) -> Column:
        placed = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            last = F.size(p) - 1
            same = lambda i, j: p[i]["h"] == p[j]["h"]
            at = F.filter(
                F.sequence(F.lit(0), last),
                lambda i: F.when(i > 0, same(i, F.greatest(i - 1, F.lit(0)))).otherwise(False)
                | F.when(i < last, same(i, F.least(i + 1, last))).otherwise(False),
            )
            return F.sort_array(F.transform(at, lambda i: p[i]["i"]))

        def cover(s: Column) -> Column:
            last = F.size(s) - 1
            gaps = F.transform(s, lambda x, i: F.when(i < last, F.least(s[F.least(i + 1, last)] - x, F.lit(n))).otherwise(F.lit(n)))
            return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

        return let(placed, lambda p: let(starts(p), cover))

    return let(
        window_hashes(hashes, n),
        lambda runs: F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("bigint")).otherwise(covered(runs)),
    )


def measures(text: Column) -> Column:
    """A struct of counts over the whole text: those of the base test and those that only the rules use."""
    t = whole(text)

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        hashes = word_hashes(w)
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"),
            let(hashes, repeated_words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        let(words(t), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        stripped_of(t, r"[\x20\x09-\x0D]+").cast("bigint").alias("word_chars"),
        stripped_of(t, SYMBOLS).cast("bigint").alias("n_symbols"),
        stripped_of(t, "[^A-Z]+").cast("bigint").alias("n_capitals"),
        stripped_of(t, "[^!?]+").cast("bigint").alias("n_shouts"),
        stripped_of(t, "[^.]+").cast("bigint").alias("n_stops"),
    )


def flat(m: str) -> list[Column]:
    """The measures in struct column ``m`` as columns."""
    inner = {"n_words": "w", "n_distinct": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_capitals", "n_shouts", "n_stops"]
    return [F.col(f"{m}.{inner[c]}.{c}" if c in inner else f"{m}.{c}").alias(c) for c in names]


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains. Both are SQL over the measures.

    most_false: the share of good documents on which the rule blames at most; what its author vouches for. Kinds of
    bad text hardly overlap, so agreement between rules alone would single out the most frequent kind; this bound is
    the outside knowledge that lets a rule be believed where it blames alone. The estimate moves freely below it.
    """

    name: str
    bad: str
    good: str
    most_false: float


#: The rules that vote, over integers only so that any engine gives the same votes.
RULES = (
    Rule("symbols", "20 * n_symbols > word_chars", "50 * n_symbols <= word_chars", 0.001),
    Rule("capitals", "3 * n_capitals > word_chars", "8 * n_capitals <= word_chars", 0.001),
    Rule("shouting", "25 * n_shouts > word_chars", "100 * n_shouts <= word_chars", 0.001),
    Rule("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words", 0.01),
    Rule("lines", "2 * n_dup_lines > n_lines", "20 * n_dup_lines <= n_lines", 0.01),
    Rule("variety", "8 * n_distinct < n_words AND n_words >= 40 AND n_words < 2000", "5 * n_distinct >= 2 * n_words", 0.01),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", 0.01),
    Rule("sentences", "n_stops = 0 AND n_words >= 60", "n_stops >= 1 AND 60 * n_stops >= n_words", 0.05),
)
VOTES = [f"v_{r.name}" for r in RULES]


def votes() -> list[Column]:
    return [F.expr(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END").alias(f"v_{r.name}") for r in RULES]


@dataclass(frozen=True)
class Model:
    """prior: of a good document. given[rule][y][v + 1]: probability of vote v (-1, 0, 1) on a bad (y 0) or good (y 1) one."""

    prior: float
    given: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]


#: Where expectation-maximisation starts: most documents are good, and bad ones are of several kinds.
START = Model(0.9, tuple(((0.3, 0.2, 0.5), (r.most_false, 0.3, 0.7 - r.most_false)) for r in RULES))
ROUNDS = 40
#: Added to each count of votes, so that no probability is 0.
SMOOTH = 1.0


def log_odds(model: Model, pattern: tuple[int, ...]) -> float:
    odds = math.log(model.prior) - math.log(1 - model.prior)
    for (bad, good), v in zip(model.given, pattern, strict=True):
        odds += math.log(good[v + 1]) - math.log(bad[v + 1]) if v else 0
    return odds


def fit(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over pattern counts, with each rule's blame of good documents held below its bound."""
    model, total = START, sum(patterns.values())
    for _ in range(rounds if total else 0):
        counts = [[[SMOOTH] * 3, [SMOOTH] * 3] for _ in RULES]
        good_mass = 0.0
        for pattern in sorted(patterns):
            n, good = patterns[pattern], 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(model, pattern)))))
            good_mass += n * good
            for k, v in enumerate(pattern):
                counts[k][1][v + 1] += n * good
                counts[k][0][v + 1] += n * (1 - good)
        given = []
        for rule, (bad, good) in zip(RULES, counts, strict=True):
            p, q = [x / sum(bad) for x in bad], [x / sum(good) for x in good]
            blame = min(q[0], rule.most_false, p[0])
            rest = (1 - blame) / (q[1] + q[2])
            given.append((tuple(p), (blame, q[1] * rest, q[2] * rest)))
        model = Model((good_mass + SMOOTH) / (total + 2 * SMOOTH), tuple(given))
    return model


def counted(voted: DataFrame) -> dict[tuple[int, ...], int]:
    """How often each pattern of votes occurs; at most 3**len(RULES) rows reach the driver."""
    return {tuple(r[v] for v in VOTES): r["n"] for r in voted.groupBy(*VOTES).agg(F.count(F.lit(1)).alias("n")).collect()}


def odds_of(model: Model) -> Column:
    """Log odds of a good document from its votes; an abstention says nothing."""
    total = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for (bad, good), v in zip(model.given, VOTES, strict=True):
        w = [math.log(g) - math.log(b) for g, b in zip(good, bad, strict=True)]
        total = total + F.when(F.col(v) == -1, w[0]).when(F.col(v) == 1, w[2]).otherwise(0.0)
    return total


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, the measures and the votes of each row's ``text``."""
    m = fresh(docs, "measured")
    named = docs.select(*[F.col(k) for k in keep], measures(F.col("text")).alias(m)).select(*keep, *flat(m))
    return named.select("*", *votes())


def judged(voted: DataFrame, model: Model) -> DataFrame:
    """Adds base_failed, p_good and kept to the measures."""
    c = {k: F.col(k) for k in ("n_words", "n_repeat_words")}
    return (
        voted.withColumn("base_failed", base_failed(c))
        .withColumn("p_good", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds_of(model))))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    )


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the measures, the votes, base_failed, p_good and kept."""
    voted = cut(measured(docs, "doc_id"))
    return judged(voted, fit(counted(voted)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all its columns.

    Each text is measured once: rows and votes are written next to each other, so that texts aren't shuffled and rows without
    an id or with a repeated one need no key. Vote patterns are counted on the written votes.
    """
    row, m = fresh(docs, "row"), "measured"
    inner = docs.select(F.struct("*").alias(row), measures(F.col("text")).alias(m)).select(row, *flat(m))
    voted = stored(inner.select("*", *votes()), "votes")
    return judged(voted, fit(counted(voted))).filter("kept").select(f"{row}.*")
