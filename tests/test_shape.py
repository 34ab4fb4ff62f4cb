import json

from quarry import shape


def test_ten_items_at_most():
    got = json.loads(shape.list_response([{"a": i} for i in range(30)], lambda s: f"{len(s)} shown"))
    assert (got["summary"], len(got["data"]), got["total"], got["truncated"]) == ("10 shown", 10, 30, True)
    assert json.loads(shape.list_response([], lambda s: "none")) == {"summary": "none", "data": [], "total": 0, "truncated": False}


def test_items_are_halved_until_they_fit():
    text = shape.list_response([{"a": "x" * 900} for _ in range(10)], lambda s: "s")
    assert len(text) <= shape.LIMIT and len(json.loads(text)["data"]) == 2


def test_strings_of_a_single_item_are_cut():
    text = shape.list_response([{"a": "x" * 9000, "b": {"c": "y" * 9000}, "d": 1}], lambda s: "s")
    assert len(text) <= shape.LIMIT


def test_impact_counts_what_it_leaves_out():
    entries = [("direct", "d", ["grpc"])] + [("transitive", f"service-{i:04}", ["grpc", "kafka"]) for i in range(300)]
    got = shape.impact_response("s", {"total": 301}, entries)
    assert len(shape.compact(got)) <= shape.LIMIT and got["direct"] == {"d": ["grpc"]}
    assert got["transitive_truncated"] == f"...and {300 - len(got['transitive'])} more"
    assert "transitive_truncated" not in shape.impact_response("s", {}, entries[:5])


def test_field_impact_drops_consumers_first():
    row = {"repo": "r" * 40}
    got = shape.field_impact_response("f", "s", [row] * 20, [], [row] * 200)
    assert len(got["origins"]) == 20 and len(shape.compact(got)) <= shape.LIMIT
    got = shape.field_impact_response("f", "s", [row] * 200, [], [row])
    assert got["consumers"] == [] and 0 < len(got["origins"]) < 200
