"""Scenario documents as text: encoding, total decoding, and drafts by the manifest they were made for.

A document is URL-safe base64 of JSON ``{"edits": [...], "zones": "coarse"}``. Each edit is one of several kinds, told by its type: CloseEdge and SetEdge
are about an edge, AddEdge about two nodes, TransitEdit about a route. Decoding raises on nothing: what is wrong with a document, or with one of its
edits, is a row of its own, and a document with an edit that can't be read has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyway.operators import feeds

KINDS = ("CloseEdge", "SetEdge", "AddEdge", "TransitEdit")
#: Fields of an edit by their type; fields of another type than theirs count as not given, but for those that tell what the edit is about.
FIELDS = {
    "type": "string", "op": "string", "edge": "bigint", "lanes": "int", "speed_mps": "double", "capacity_vph": "double",
    "from": "bigint", "to": "bigint", "route_id": "string", "headway_s": "double", "stops": "array<bigint>",
}
#: How finely the demand loads; the first where none or an unknown one is named.
ZONES = ("full", "coarse")


def target(edit: Column) -> Column:
    """What an edit is about, in an order that puts edges before added edges before routes."""
    kind = edit["type"]
    return (
        F.when(kind.isin("CloseEdge", "SetEdge"), F.format_string("0:%012d", edit["edge"]))
        .when(kind == "AddEdge", F.format_string("1:%012d:%012d", edit["from"], edit["to"]))
        .otherwise(F.concat(F.lit("2:"), edit["route_id"]))
    )


def canonical(edits: DataFrame) -> DataFrame:
    """The last of ``edits(doc, seq, edit)`` about each target, in the order of targets: equal scenarios are equal rows."""
    rows = edits.withColumn("target", target(F.col("edit")))
    return rows.groupBy("doc", "target").agg(F.max_by("edit", "seq").alias("edit"))


def encoded(edits: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """doc and code of each document of ``edits(doc, seq, edit)``, edit a struct of FIELDS; ``zones(doc, zones)`` where not the first.

    Fields that aren't given, and the first zones, are left out, and edits are canonical, so equal scenarios have equal codes. A document is one row.
    """
    each = canonical(edits).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("target", "edit"))), lambda x: x["edit"]).alias("edits"))
    whole = each if zones is None else each.join(zones.filter(F.col("zones") != ZONES[0]), "doc", "left")
    text = F.to_json(F.struct("edits", *([] if zones is None else ["zones"])))
    return whole.select("doc", F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/\r\n", "-_"), F.lit("=")).alias("code"))


def parsed(codes: DataFrame) -> DataFrame:
    """``codes(doc, code)`` with the document as a variant, null where the code isn't one."""
    plain = F.translate("code", "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)).cast("int")))
    told = F.when(F.col("code").rlike("^[A-Za-z0-9_-]+$") & (F.length("code") % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return codes.select("doc", "code", F.try_parse_json(F.try_validate_utf8(told.cast("string"))).alias("value"))


def parts(codes: DataFrame) -> DataFrame:
    """doc, seq and value of each edit of the documents that list edits."""
    listed = parsed(codes).select("doc", F.try_variant_get("value", "$.edits", "array<variant>").alias("edits"))
    return listed.select("doc", F.posexplode("edits").alias("seq", "value"))


def read(value: Column) -> Column:
    """The edit's fields; those that aren't given, or of another type, are null."""
    return F.struct(*[F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in FIELDS.items()])


def wrong(value: Column) -> Column:
    """Why a part is no edit; null if it is one. What it is about must be there, and a number or a text as its kind asks."""
    kind = F.try_variant_get(value, "$.type", "string")
    of = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))
    as_ = lambda name, kind: F.try_variant_get(value, f"$.{name}", kind)
    number = lambda name: of(name).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$") & F.coalesce(as_(name, "bigint") == as_(name, "double"), F.lit(False))
    text = lambda name: of(name) == "STRING"
    return (
        F.when(~of("type").eqNullSafe("STRING") | ~F.coalesce(kind.isin(*KINDS), F.lit(False)), "unknown type")
        .when(kind.isin("CloseEdge", "SetEdge") & ~number("edge"), "no edge")
        .when((kind == "AddEdge") & ~(number("from") & number("to")), "no ends")
        .when((kind == "TransitEdit") & ~text("route_id"), "no route")
    )


def errors(codes: DataFrame) -> DataFrame:
    """doc, seq (null for the document itself) and reason of everything that can't be decoded."""
    whole = parsed(codes).select(
        "doc", F.lit(None).cast("int").alias("seq"),
        F.when(F.col("value").isNull(), "not a document").when(F.try_variant_get("value", "$.edits", "array<variant>").isNull(), "no list of edits").alias("reason"),
    )
    each = parts(codes).select("doc", "seq", wrong(F.col("value")).alias("reason"))
    return whole.unionByName(each).filter("reason IS NOT NULL")


def decoded(codes: DataFrame) -> DataFrame:
    """doc, seq and edit of the documents of which every part is right; a document without edits has no rows here.

    Whether all are right is asked within the row, so each code is read once and nothing is shuffled; a doc that repeats is judged row by row.
    """
    listed = parsed(codes).select("doc", F.try_variant_get("value", "$.edits", "array<variant>").alias("edits"))
    right = listed.filter(~F.exists("edits", lambda e: wrong(e).isNotNull()))
    return right.select("doc", F.posexplode("edits").alias("seq", "value")).select("doc", "seq", read(F.col("value")).alias("edit"))


def documents(codes: DataFrame) -> DataFrame:
    """doc and zones of the documents that can be decoded; unknown zones are the first."""
    bad = errors(codes).select("doc").distinct()
    named = F.try_variant_get("value", "$.zones", "string")
    return parsed(codes).join(bad, "doc", "left_anti").select("doc", F.when(named.isin(*ZONES[1:]), named).otherwise(ZONES[0]).alias("zones"))


def saved(drafts: DataFrame, new: DataFrame) -> DataFrame:
    """``drafts(manifest, name, code)`` with those of ``new`` in place of what they replace; a draft is kept under the hash of its manifest and its name."""
    keyed = lambda rows: rows.select(F.to_json(F.struct("manifest", "name")).alias("key"), "manifest", "name", "code")
    return feeds.upserted(keyed(drafts), keyed(new), "key").drop("key")


def loaded(drafts: DataFrame, manifest: str, name: str) -> DataFrame:
    """doc (the name) and code of the draft, to be decoded; no rows without one, or under another manifest."""
    return drafts.filter((F.col("manifest") == manifest) & (F.col("name") == name)).select(F.col("name").alias("doc"), "code")


def cleared(drafts: DataFrame, manifest: str, name: str) -> DataFrame:
    return drafts.filter(~((F.col("manifest") == manifest) & (F.col("name") == name)))
