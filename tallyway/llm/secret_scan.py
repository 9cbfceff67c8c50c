"""Secret scans whose doubtful finds are settled by corpus-wide ownership frequency.

Three strict patterns (assign, access, hex) always report. A fourth, wide one takes any long mixed token as a
candidate. Candidates' hashes are aggregated over the corpus by distinct repositories and distinct owners: a value
that many owners hold is a copied example, one that stays with an owner or two and looks random is a live-looking
credential and is reported as ``owned``. Strict finds carry the same two counts.

Everything is DataFrame expressions. Texts are scanned in their own rows and never shuffled; what is shuffled are
spans and value hashes, made distinct per (value, owner, repository) before anything is counted, so a value copied
into a third of all rows is counted map-side first.

Defined results: a null text is empty and has no spans; the hash of no spans is that of the empty string. A null
owner or repository counts as one of its own. Rows with equal doc_id and text get the same spans. Positions are in
code points, ends exclusive. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.llm.tables import cut, fresh, let, small
from tallyway.llm.text import whole

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Whole runs of token letters, of 20 or more.
WIDE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", "owned")
#: From so many owners or repositories on, a value is an example that people copy.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
BARE = "array<struct<start:int,rank:int,end:int>>"
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"


def located(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's leftmost non-overlapping matches, in order, whose ``group`` has ``least`` letters or more.

    The text split by the pattern gives what lies between matches, so running lengths give each match's place.
    """
    empty = F.array().cast(SPAN)

    def placed(hits: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            step = lambda a, i: F.struct(
                (a["at"] + F.length(gaps[i]) + F.length(hits[i])).alias("at"),
                F.concat(a["starts"], F.array(a["at"] + F.length(gaps[i]))).alias("starts"),
            )
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
            return F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1), zero, step, lambda a: a["starts"])

        def spans(starts: Column, values: Column) -> Column:
            return F.transform(
                hits,
                lambda h, i: F.struct(
                    starts[i].alias("start"), F.lit(rank).alias("rank"), (starts[i] + F.length(h)).alias("end"), values[i].alias("value")
                ),
            )

        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
        made = let(let(F.split(text, pattern, -1), with_gaps), lambda starts: let(values, lambda v: spans(starts, v)))
        return F.when(F.size(hits) > 0, F.filter(made, lambda s: F.length(s["value"]) >= least)).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def looks_random(value: Column) -> Column:
    """Letters of both kinds or digits among letters, and many different ones."""
    marks = F.regexp_replace(value, "[^0-9]+", "")
    letters = F.regexp_replace(value, "[^A-Za-z]+", "")
    return (F.length(marks) >= 4) & (F.length(letters) >= 4) & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def spans(text: Column) -> Column:
    """Struct of ``base`` spans by start and kind, and of ``wide`` ones that no base span touches."""
    t = whole(text)
    base = F.array_sort(F.concat(located(t, ASSIGN, 0, 1, 6), located(t, ACCESS, 1), located(t, HEX, 2)))
    wide = F.filter(located(t, WIDE, 3), lambda s: looks_random(s["value"]))
    free = lambda b: F.filter(wide, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    return let(base, lambda b: F.struct(b.alias("base"), free(b).alias("wide")))


def scanned(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """doc_id, row_key (of doc_id and text), owner, repository, base and wide spans."""
    made = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), spans(F.col("text")).alias("s")
    )
    return made.select("doc_id", "row_key", "owner", "repository", "s.base", "s.wide")


def ownership(found: DataFrame) -> DataFrame:
    """For each value hash among all spans: n_repositories and n_owners that hold it."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "wide")).alias("span"))
    held = each.select(F.xxhash64("span.value").alias("value_hash"), "owner", "repository").distinct()
    owners = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return owners.groupBy("value_hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def copied() -> Column:
    """Whether owners and repositories are so many that the value of a row of ``ownership`` is an example."""
    return (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_repositories") >= EXAMPLE_REPOSITORIES)


def findings(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per span: doc_id, row_key, kind, start, end, value_hash, n_repositories, n_owners and verdict.

    verdict: ``example`` from EXAMPLE_OWNERS owners or EXAMPLE_REPOSITORIES repositories on, else ``live``. Wide candidates are there with either verdict;
    only the live ones are finds.
    """
    return findings_of(cut(scanned(docs, owner, repository)))


def findings_of(found: DataFrame) -> DataFrame:
    each = found.select("doc_id", "row_key", F.explode(F.concat("base", "wide")).alias("span"))
    rows = each.select("doc_id", "row_key", "span.start", "span.rank", "span.end", F.xxhash64("span.value").alias("value_hash"))
    counts = small(cut(ownership(found)))
    return rows.join(counts, "value_hash").select(
        "doc_id", "row_key", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind"), "start", "end", "rank",
        "value_hash", "n_repositories", "n_owners",
        F.when(copied(), "example").otherwise("live").alias("verdict"),
    )


def added(found: DataFrame) -> DataFrame:
    """row_key and its ``owned`` spans: wide candidates that prove live."""
    wide = found.filter(F.size("wide") > 0).select("row_key", F.explode("wide").alias("span"))
    rows = wide.select("row_key", "span.start", "span.rank", "span.end", F.xxhash64("span.value").alias("value_hash")).distinct()
    live = small(cut(ownership(found).filter(~copied()).select("value_hash")))
    one = F.struct("start", "rank", "end")
    return rows.join(live, "value_hash", "left_semi").groupBy("row_key").agg(F.collect_list(one).alias("owned"))


def spelled(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text and the two columns): counts by kind, base and all spans."""
    found = cut(scanned(docs, owner, repository))
    bare = lambda a: F.transform(F.col(a), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("bigint")
    none = F.array().cast(BARE)
    return found.join(small(cut(added(found))), "row_key", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat(bare("base"), F.coalesce("owned", none)))).alias("spans"),
        F.coalesce(F.size("owned"), F.lit(0)).cast("bigint").alias("n_owned"),
    )


def masked(text: Column, spans_: Column, mask: str) -> Column:
    """``text`` with each span replaced by ``mask``; spans that touch or overlap become one."""

    def piece(s: Column) -> Column:
        # The text before each span, from the furthest end of all spans before it.
        last = F.transform(s, lambda x, i: F.array_max(F.transform(F.slice(s, 1, i), lambda y: y["end"])))
        parts = F.transform(
            s,
            lambda x, i: F.when(i == 0, F.concat(F.substring(text, F.lit(1), x["start"]), F.lit(mask)))
            .when(x["start"] > last[i], F.concat(F.substring(text, last[i] + 1, x["start"] - last[i]), F.lit(mask)))
            .otherwise(""),
        )
        tail = F.substring(text, F.array_max(F.transform(s, lambda y: y["end"])) + 1, F.length(text))
        return F.concat(F.array_join(parts, ""), tail)

    return F.when(F.size(spans_) > 0, let(F.array_sort(spans_), piece)).otherwise(text)


def mask_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """``docs`` with all its columns, every base span and every ``owned`` one masked in ``text``; null texts stay null.

    n_chars, where ``docs`` has it, is the length of the new text.
    """
    extra = added(cut(scanned(docs, owner, repository).filter(F.size("base") + F.size("wide") > 0)))
    key, names = fresh(docs, "row_key"), docs.columns
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    extra = small(cut(extra.withColumnRenamed("row_key", key)))
    base = F.transform(spans(F.col("text"))["base"], lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    owned = fresh(docs, "owned")
    joined = keyed.join(extra.withColumnRenamed("owned", owned), key, "left")
    text = F.when(F.col("text").isNotNull(), let(F.concat(base, F.coalesce(F.col(owned), F.array().cast(BARE))), lambda s: masked(F.col("text"), s, mask)))
    out = joined.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))
    return out.select(*names)
