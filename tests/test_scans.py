"""Recognition payloads of all shapes as literal rows."""

import json

import pytest

from evidenza.sources.scans import NOWHERE, payload_lines

SQUARE = [[0, 0], [2, 0], [2, 1], [0, 1]]
CORNERS = [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]


def floats(box):
    return [[float(x) for x in p] for p in box]


SHAPES = {
    "side by side": ({"rec_texts": ["a", " b  c ", ""], "rec_scores": [0.9, "0.5"], "rec_polys": [SQUARE, [1, 2, 3, 4]]}, [("a", 0.9, floats(SQUARE)), ("b c", 0.5, CORNERS)]),
    "under res": ({"res": {"texts": ["a"], "scores": ["x"]}, "texts": ["no"]}, [("a", 0.0, NOWHERE)]),
    "under data": ({"data": [{"texts": ["a"]}, {"data": {"rec_text": "one", "rec_score": [None]}}]}, [("a", 1.0, NOWHERE), ("one", 1.0, NOWHERE)]),
    "null names": ({"res": None, "data": "x", "rec_texts": None, "texts": ["a", 7, None]}, [("a", 1.0, NOWHERE), ("7", 1.0, NOWHERE)]),
    "pairs": ([[[SQUARE, ["a", 0.25]], [[1, 2, 3, 4, 5, 6, 7, 8, 9], ["b"]]]], [("a", 0.25, floats(SQUARE)), ("b", 1.0, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]])]),
    "one pair": ([SQUARE, ["a", None]], [("a", 1.0, floats(SQUARE))]),
    "odd boxes": ({"texts": list("abcd"), "boxes": [[1, 2, 3], [[1, 2], [3]], [[1, "2"], ["x", 1], [3, 4, 5], [5, 6], [7, 8], [9, 9]], "no"]}, [("a", 1.0, NOWHERE), ("b", 1.0, NOWHERE), ("c", 1.0, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0], [7.0, 8.0]]), ("d", 1.0, NOWHERE)]),
    "mixed list": ([None, 3, "text", [], {"texts": []}, {"other": 1}, {"texts": ["z"]}], [("z", 1.0, NOWHERE)]),
    "nothing": ({}, []),
}


def test_all_shapes(spark):
    rows = [(name, json.dumps(payload), "mine", 2**60 + i) for i, (name, (payload, _)) in enumerate(SHAPES.items())] + [("null", None, "mine", None), ("no json", "{", "mine", 1)]
    out = payload_lines(spark.createDataFrame(rows, "name string, payload string, line_ string, k long").repartition(2))
    assert out.columns == ["name", "line_", "k", "record", "position", "line", "score", "box"]
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.position):
        got.setdefault(r.name, []).append((r.line, r.score, r.box))
    assert got == {name: lines for name, (_, lines) in SHAPES.items() if lines}


def test_depth(spark):
    deep = {"texts": ["a"]}
    for _ in range(3):
        deep = [{"data": deep}]
    df = spark.createDataFrame([(json.dumps(deep),)], "payload string")
    assert [r.line for r in payload_lines(df).collect()] == ["a"]
    with pytest.raises(Exception, match="nested deeper than 4"):
        payload_lines(df, levels=4).collect()
