"""Documents: what is written is read again, hostile strings included."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framepack.errors import ParseError
from framepack.sources.grammar import decode, tokenize
from framepack.sources.writer import encode, encode_value

HOSTILE = ["", "null", "true", "12", "1e5", "2025-01-15", "10:30:00", "a|b", "a,b", "a*3", "#x", "C#", "http://h/p", "a:b", "[x]", "{x}", "~", "@dict:x", "New York", "t\tn\nq\"b\\", "é", "\U0001f389", "-", "/*", "550e8400-e29b-41d4-a716-446655440000"]


def test_hostile_strings_round_trip():
    rows = [{"id": i, "s": s, "n": None} for i, s in enumerate(HOSTILE)]
    assert decode(encode_value({"t": rows})) == {"t": rows}
    assert decode(encode_value({"e": {"k" + s: s for s in HOSTILE}, "x": 1})) == {"e": {"k" + s: s for s in HOSTILE}, "x": 1}


@pytest.mark.parametrize("value", [[1, 2, 3], {"d": [1, 2]}, {"a": {"b": {"c": [1, "x", True], "d": {}}}, "e": [{"x": 1}, {"x": 2}], "f": []}, "hello world", -1.5, None, {"x": 1e21, "y": 1e-7, "z": 2**53}, [], {"rows": []}])
def test_values_round_trip(value):
    assert decode(encode_value(value)) == value


json_values = st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: x != int(x) if abs(x) < 1e15 else False) | st.text(max_size=8), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(min_size=1, max_size=5), inner, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(min_size=1, max_size=5), json_values, min_size=2, max_size=4))
def test_any_object_round_trips(value):
    assert decode(encode_value(value)) == value


def test_documented_table():
    text = "users::[2] id:u8|name:str|active:bool\n  1|Ann|true\n  2|Bo|false"
    assert decode(text) == {"users": [{"id": 1, "name": "Ann", "active": True}, {"id": 2, "name": "Bo", "active": False}]}


def test_directives():
    text = '::[4] a:str@dictionary|b:u8@delta|c:str@rle|d:bool@bits\n@dict:a [x, "New York"]\n@idx:a 0,1,0,1\n@delta:b 5|+1|-2|+0\n@rle:c k*3|z\n@bits:d "A" 4'
    rows = decode(text)
    assert [r["a"] for r in rows] == ["x", "New York", "x", "New York"]
    assert [r["b"] for r in rows] == [5, 6, 4, 4]
    assert [r["c"] for r in rows] == ["k", "k", "k", "z"]
    assert [r["d"] for r in rows] == [True, False, True, False]


@pytest.mark.parametrize("text", ["{", "x::[2] a:u8\n  1", "x::[1] a:u8|b:u8\n  1", "1 2", "::[1]@other a", "::[1] a:u8\n@dict:a [x]\n@idx:a 3", '"open'])
def test_errors(text):
    with pytest.raises(ParseError):
        decode(text)


def test_tokens():
    assert [t.type for t in tokenize('a: [1] # c\n"x"')] == ["WORD", "MARK", "MARK", "NUMBER", "MARK", "NEWLINE", "STRING", "END"]


def test_cycles_and_depth():
    loop = {"a": 1}
    loop["b"] = loop
    with pytest.raises(ValueError):
        encode_value(loop)
    deep = {}
    for _ in range(150):
        deep = {"a": deep, "b": 1}
    with pytest.raises(ValueError):
        encode_value(deep)


def test_layouts_and_sizes(spark):
    rows = [(i, f"User{i}", i % 2 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, name string, active boolean")
    text = encode(df, ["id"], "users")
    import json

    plain = json.dumps({"users": [r.asDict() for r in df.collect()]}, indent=2)
    assert len(text) < 0.6 * len(plain)
    for mode in ("compact", "columnar", "stream", "sparse"):
        assert decode(encode(df, ["id"], "users", mode=mode))["users"] == [{"id": a, "name": b, "active": c} for a, b, c in rows]
    assert decode(encode(df, ["id"], "users", compression=True))["users"][3] == {"id": 3, "name": "User3", "active": False}
    assert "# Token statistics" in encode(df, ["id"], "users", stats=True)
    empty = df.where("id < 0")
    for mode in ("compact", "columnar", "stream", "sparse"):
        assert decode(encode(empty, ["id"], "users", mode=mode)) == {"users": []}


def test_odd_numbers(spark):
    df = spark.createDataFrame([(0, 1e21), (1, 1.5e-7), (2, float("inf")), (3, float("-inf")), (4, None), (5, 0.1), (6, 123456.789), (7, -0.00012), (8, 1e15 + 0.5)], "i int, x double")
    got = [r["x"] for r in decode(encode(df, ["i"], "t", mode="compact"))["t"]]
    assert got == [1e21, 1.5e-7, math.inf, -math.inf, None, 0.1, 123456.789, -0.00012, 1e15 + 0.5]


def test_command_line(tmp_path, spark, capsys):
    import json

    from framepack.cli import main

    value = {"metrics": [{"day": i, "views": 10 * i, "name": f"n {i}"} for i in range(12)]}
    (tmp_path / "a.json").write_text(json.dumps(value))
    main(["encode", str(tmp_path / "a.json"), "-o", str(tmp_path / "a.fp"), "-c"])
    main(["decode", str(tmp_path / "a.fp"), "-o", str(tmp_path / "b.json")])
    assert json.loads((tmp_path / "b.json").read_text()) == value
    main(["compare", str(tmp_path / "a.json")])
    main(["stats", str(tmp_path / "a.json")])
    main(["validate", str(tmp_path / "a.fp")])
    assert "valid" in capsys.readouterr().out
    (tmp_path / "s.json").write_text(json.dumps({"name": "m", "fields": [{"name": "day", "type": "u8"}, {"name": "views", "type": "i8"}]}))
    main(["validate", str(tmp_path / "a.fp"), "--schema", str(tmp_path / "s.json")])
