"""Scenario documents that are whole, broken or odd, drafts, and edits of transit service."""

import base64
import json

from tallyway.operators import documents, service, transit

CODES = "doc string, code string"


def code_of(value):
    raw = value if isinstance(value, bytes) else (value if isinstance(value, str) else json.dumps(value)).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def table(spark, values):
    return spark.createDataFrame([(k, v) for k, v in values.items()], CODES)


def test_round_trip(spark):
    """Order and overwritten edits make no difference to the code; it decodes to the canonical edits."""
    kinds = ", ".join(f"{n}:{t}" for n, t in documents.FIELDS.items())
    schema = f"doc string, seq long, edit struct<{kinds}>"
    edit = lambda **k: tuple(k.get(n.replace("from", "from_") if n == "from" else n) for n in documents.FIELDS)
    one = [("a", 1, edit(type="CloseEdge", edge=12)), ("a", 2, edit(type="SetEdge", edge=3, lanes=2)), ("a", 3, edit(type="TransitEdit", op="AddPattern", route_id="r", stops=[4, 5], headway_s=600.0)),
           ("a", 4, edit(type="AddEdge", from_=1, to=2)), ("a", 5, edit(type="SetEdge", edge=3, lanes=4, speed_mps=9.5))]
    other = [("b", 9 - s, e) for _, s, e in one if s != 2]
    codes = documents.encoded(spark.createDataFrame(one + other, schema))
    got = {r["doc"]: r["code"] for r in codes.collect()}
    assert got["a"] == got["b"] and set(got["a"]) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")
    back = documents.decoded(codes.filter("doc = 'a'")).orderBy("seq").select("edit.*").collect()
    assert [(r["type"], r["edge"], r["lanes"], r["speed_mps"], r["route_id"], r["stops"]) for r in back] == [
        ("SetEdge", 3, 4, 9.5, None, None), ("CloseEdge", 12, None, None, None, None), ("AddEdge", None, None, None, None, None), ("TransitEdit", None, None, None, "r", [4, 5])
    ]
    again = documents.encoded(documents.decoded(codes.filter("doc = 'a'"))).first()["code"]
    assert again == got["a"] and documents.errors(codes).count() == 0


BROKEN = {
    "signs": "@@@", "length": "abcde", "json": code_of('{"edits":'), "bytes": code_of(b"\xff\xfe{}"), "null": None, "empty": "",
    "a number": code_of("5"), "no list": code_of({"edits": 5}), "no edits": code_of({"zones": "full"}),
}
PARTS = [
    {"type": "CloseEdge", "edge": 5}, {"type": "CloseEdge", "edge": "5"}, {"type": "SetEdge"}, {"type": "SetEdge", "edge": 1.5}, {"type": "CloseEdge", "edge": 1e300}, {"type": "Nope"}, {"edge": 4}, {"type": 7},
    5, None, [], {"type": "TransitEdit"}, {"type": "TransitEdit", "route_id": 4}, {"type": "AddEdge", "from": 1}, {"type": "AddEdge", "from": 1, "to": 2}, {"type": "SetEdge", "edge": 6, "lanes": "x"},
]
REASONS = {1: "no edge", 2: "no edge", 3: "no edge", 4: "no edge", 5: "unknown type", 6: "unknown type", 7: "unknown type", 8: "unknown type", 9: "unknown type", 10: "unknown type", 11: "no route", 12: "no route", 13: "no ends"}


def test_broken_documents_are_rows(spark):
    codes = table(spark, BROKEN | {"parts": code_of({"edits": PARTS}), "fine": code_of({"edits": [PARTS[0], PARTS[15]], "zones": "odd"}), "none": code_of({"edits": [], "zones": "coarse", "more": 1})})
    errors = {(r["doc"], r["seq"]): r["reason"] for r in documents.errors(codes).collect()}
    whole = {k: "no list of edits" if k in ("a number", "no list", "no edits") else "not a document" for k in BROKEN}
    assert errors == {(k, None): v for k, v in whole.items()} | {("parts", k): v for k, v in REASONS.items()}
    got = documents.decoded(codes).collect()
    assert sorted((r["doc"], r["seq"], r["edit"]["edge"], r["edit"]["lanes"]) for r in got) == [("fine", 0, 5, None), ("fine", 1, 6, None)]
    assert {tuple(r) for r in documents.documents(codes).collect()} == {("fine", "full"), ("none", "coarse")}
    assert documents.decoded(codes.filter("false")).count() == documents.errors(codes.filter("false")).count() == 0


def test_drafts(spark):
    schema = "manifest string, name string, code string"
    old = spark.createDataFrame([("m1", "autosave", "x"), ("m2", "autosave", "y")], schema)
    kept = documents.saved(old, spark.createDataFrame([("m1", "autosave", code_of({"edits": [PARTS[0]]})), ("m1", "mine", "z")], schema))
    assert {(r["manifest"], r["name"]) for r in kept.collect()} == {("m1", "autosave"), ("m1", "mine"), ("m2", "autosave")}
    assert documents.decoded(documents.loaded(kept, "m1", "autosave")).first()["edit"]["edge"] == 5
    assert documents.loaded(kept, "m3", "autosave").count() == 0 and documents.cleared(kept, "m1", "mine").count() == 2


EDITS = "seq long, op string, route string, stops array<long>, headway_s double"


def test_service_edits(spark):
    """The last edit of a route holds; a removal takes all patterns of a route; a stop that isn't a node breaks the ride."""
    nodes = spark.createDataFrame([(k, 0.01 * k, 0.0) for k in range(6)], "node long, lon double, lat double")
    calls = spark.createDataFrame([(p, r, s, p + s, 60.0 * s, 600.0) for p, r in ((0, "a"), (1, "a"), (2, "b")) for s in (0, 1)], "pattern long, route string, seq int, node long, along_s double, headway_s double")
    edits = [
        (1, "AddPattern", "b", [0, 5], 300.0), (2, "RemoveRoute", "a", None, None), (3, "AddPattern", "b", [0, 9, 2, 3], 1200.0), (4, "AddPattern", "c", [4], 600.0), (5, "AddPattern", "d", [1, 2], 0.0),
        (6, "RemoveRoute", "e", None, None), (7, "AddPattern", "f", [1, 2], 600.0), (8, "RemoveRoute", "f", None, None), (9, "AddPattern", None, [1, 2], 600.0),
    ]
    for order in (edits, edits[::-1]):
        frame = spark.createDataFrame(order, EDITS)
        got = sorted((r["pattern"], r["route"], r["seq"], r["node"], r["headway_s"]) for r in service.edited(calls, frame, nodes, 100).collect())
        assert got == [(2, "b", 0, 2, 600.0), (2, "b", 1, 3, 600.0), (103, "b", 0, 0, 1200.0), (103, "b", 1, None, 1200.0), (103, "b", 2, 2, 1200.0), (103, "b", 3, 3, 1200.0)]
        faults = {tuple(r) for r in service.faults(frame, nodes, calls).collect()}
        assert faults == {(3, "a stop is missing"), (4, "fewer than two stops"), (5, "no headway"), (6, "no such route"), (8, "no such route")}
    along = {r["seq"]: r["along_s"] for r in service.edited(calls, frame, nodes, 100).filter("pattern = 103").collect()}
    assert along[0] == along[1] == along[2] == 0 and abs(along[3] - 0.01 * 111320 / service.RIDE_MPS) < 1
    none = spark.createDataFrame([], "src long, dst long, cost double")
    starts = spark.createDataFrame([(0, 2, 0.0)], "origin long, node long, cost double")
    reach = {r["node"]: r["cost"] for r in transit.isochrone(none, service.boardable(service.edited(calls, frame, nodes, 100)), starts, 3600.0).collect()}
    assert reach == {2: 0.0, 3: 360.0}
    assert service.edited(calls, frame.filter("false"), nodes, 100).count() == 6
