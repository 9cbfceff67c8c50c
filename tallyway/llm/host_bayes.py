"""A quality classifier by hierarchical empirical Bayes.

A document's own evidence is a naive Bayes log-likelihood ratio over binned measures of its text, counted on labelled
documents by one grouped aggregation. Its site speaks too: a host's posterior is the mean quality of its documents, shrunk
towards the global prior the more the fewer documents it has, and a path's posterior is shrunk towards its host's. How
strongly is estimated from the data: the variance between sites beyond what sampling explains. A document's posterior
joins its evidence with the posterior of its path as the other documents of the path see it.

All statistics cover all rows. Hosts and paths are summed per key before they are shuffled.

Defined results: a null text is empty; a null host or path counts as ''. Repeated rows count as often as they occur.
Without labels the evidence is 0 for all and posteriors are the prior. A single document has its own evidence and the
global prior. Other columns don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.llm import weak_rules
from tallyway.llm.tables import cut, small

#: Ratios of measures (numerator, denominator) and the bounds between their bins.
FEATURES = {
    "symbols": ("n_symbols", "word_chars", (0.005, 0.02, 0.05, 0.1, 0.2)),
    "capitals": ("n_capitals", "word_chars", (0.01, 0.03, 0.06, 0.12, 0.3)),
    "shouts": ("n_shouts", "word_chars", (0.005, 0.02, 0.05, 0.15)),
    "stops": ("n_stops", "n_words", (0.005, 0.03, 0.08, 0.2, 0.5)),
    "repeats": ("n_repeat_words", "n_words", (0.02, 0.1, 0.2, 0.5)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.05, 0.2, 0.5)),
    "variety": ("n_distinct", "n_words", (0.05, 0.2, 0.35, 0.5, 0.7, 0.9)),
    "word_length": ("word_chars", "n_words", (2.5, 3.5, 4.5, 5.5, 7.0, 9.0)),
    "words": ("n_words", None, (3, 10, 20, 50, 100, 400, 2000)),
}
SMOOTH = 1.0
#: Naive Bayes counts dependent measures as if they were not; its log ratios are scaled by this.
TEMPER = 0.7
#: Strength of shrinking, in documents: its least and most.
WEAKEST, STRONGEST = 2.0, 10_000.0
#: Keeping a bad document costs one; losing a good one costs this.
LOSS = 3.0
#: Least posterior of a document that is kept where no labels tell it, and between which bounds labels may put it.
KEEP, LEAST, MOST = 0.1, 0.02, 0.98
#: Steps of log odds in which the threshold is looked for.
STEPS = 5


@dataclass(frozen=True)
class Evidence:
    """Log-likelihood ratio of good against bad for each feature and bin, and the labelled share of good."""

    ratios: dict[str, tuple[float, ...]]
    prior: float


def bins() -> list[Column]:
    made = []
    for name, (over, under, bounds) in FEATURES.items():
        value = F.col(over) / F.greatest(F.col(under), F.lit(1)) if under else F.col(over)
        made.append(sum((F.when(value >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int").alias(f"b_{name}"))
    return made


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path and the bins of each row's whole text."""
    named = docs.select("doc_id", "text", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    counts = weak_rules.measured(named, "doc_id", "host", "path")
    return counts.select("doc_id", "host", "path", *bins())


def learnt(rows: DataFrame, labels: DataFrame) -> Evidence:
    """Counts (feature, bin, label) over all labelled rows: at most as many rows as there are bins reach the driver."""
    pairs = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in FEATURES])
    each = rows.join(told(labels), "doc_id").select("quality", F.explode(pairs).alias("x"))
    counts = {(r["f"], r["b"], r["quality"]): r["n"] for r in each.groupBy("quality", F.col("x.f").alias("f"), F.col("x.b").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    first = next(iter(FEATURES))
    good, bad = (sum(n for (f, _, q), n in counts.items() if f == first and (q > 0) == y) for y in (True, False))
    ratios = {}
    for f, (_, _, bounds) in FEATURES.items():
        k = len(bounds) + 1
        share = lambda b, y, f=f, k=k: (sum(n for (g, c, q), n in counts.items() if g == f and c == b and (q > 0) == y) + SMOOTH) / ((good if y else bad) + SMOOTH * k)
        ratios[f] = tuple(TEMPER * (math.log(share(b, True)) - math.log(share(b, False))) for b in range(k))
    return Evidence(ratios, (good + SMOOTH) / (good + bad + 2 * SMOOTH))


def evidence_of(model: Evidence) -> Column:
    total = F.lit(0.0)
    for f, ratios in model.ratios.items():
        total = total + F.element_at(F.array(*map(F.lit, ratios)), F.col(f"b_{f}") + 1)
    return total


def odds(p: Column) -> Column:
    return F.log(p) - F.log(F.lit(1.0) - p)


def chance(odds_: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds_))


def strength(mean: float | None, between: float | None, noise: float | None) -> float:
    """Documents' worth of a prior with this mean for groups whose means vary so: the beta distribution's moments."""
    if mean is None or between is None or not 0 < mean < 1:
        return STRONGEST
    true = between - (noise or 0.0)
    return STRONGEST if true <= 0 else min(STRONGEST, max(WEAKEST, mean * (1 - mean) / true - 1))


def spread(groups: DataFrame, around: Column) -> tuple[float | None, float | None]:
    """Variance of the groups' means around their centres, weighted by documents, and what sampling explains of it."""
    m = F.col("s") / F.col("n")
    row = groups.agg(F.sum(F.col("n") * (m - around) ** 2).alias("v"), F.sum(m * (1 - m)).alias("e"), F.sum("n").alias("n")).first()
    return (row["v"] / row["n"], row["e"] / row["n"]) if row["n"] else (None, None)


def threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The posterior from which keeping labelled documents costs least; of equal ones the lowest.

    Labelled rows are counted by steps of their log odds, so that a few hundred rows reach the driver.
    """
    step = F.floor(odds(F.least(F.greatest(F.col("p_quality"), F.lit(LEAST)), F.lit(MOST))) * STEPS).alias("step")
    rows = scored.join(told(labels), "doc_id").groupBy(step).agg(F.sum((F.col("quality") > 0).cast("int")).alias("good"), F.count(F.lit(1)).alias("n")).collect()
    steps = sorted((r["step"], r["good"], r["n"] - r["good"]) for r in rows)
    if not steps:
        return KEEP
    cost = bad = sum(b for _, _, b in steps)
    best, lost = steps[0][0], 0
    for k, (_, g, b) in enumerate(steps[:-1]):
        lost, bad = lost + g, bad - b
        if LOSS * lost + bad < cost:
            cost, best = LOSS * lost + bad, steps[k + 1][0]
    return min(MOST, max(LEAST, 1 / (1 + math.exp(-best / STEPS))))


def told(labels: DataFrame) -> DataFrame:
    """One label for each doc_id, the better one where they differ."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, host_posterior, path_posterior, p_quality and kept."""
    rows = cut(measured(docs, host, path))
    model = learnt(rows, labels)
    own = cut(rows.select("doc_id", "host", "path", evidence_of(model).alias("evidence")))
    alone = chance(F.lit(math.log(model.prior) - math.log(1 - model.prior)) + F.col("evidence"))
    paths = cut(own.groupBy("host", "path").agg(F.sum(alone).alias("s"), F.count(F.lit(1)).alias("n")))
    hosts = cut(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = (total["s"] + model.prior) / (total["n"] + 1) if total["n"] else model.prior
    of_host = strength(prior, *spread(hosts, F.lit(prior)))
    seen = hosts.select("host", ((F.col("s") + of_host * prior) / (F.col("n") + of_host)).alias("host_posterior"))
    both = paths.join(small(seen), "host")
    of_path = strength(prior, *spread(both, F.col("host_posterior")))
    sites = small(cut(both.select("host", "path", "s", "n", "host_posterior")))
    scored = own.join(sites, ["host", "path"])
    others = (F.col("s") - alone + of_path * F.col("host_posterior")) / (F.col("n") - 1 + of_path)
    bounded = F.least(F.greatest(others, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = scored.select(
        "doc_id", "evidence", "host_posterior",
        ((F.col("s") + of_path * F.col("host_posterior")) / (F.col("n") + of_path)).alias("path_posterior"),
        chance(odds(bounded) + F.col("evidence")).alias("p_quality"),
    )
    return posterior.withColumn("kept", F.col("p_quality") >= threshold(posterior, labels))
