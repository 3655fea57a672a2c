"""Strict JSON against a corpus of valid and invalid texts, the RFC examples, and properties."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textspark.core import JsonParseOptions, JsonWriteOptions, TextError
from textspark.functions import json_model as J

VALID = [
    "null", "[]", "{}", "[1,2,3]", '{"a":1}', '{"o1":{"o2":{"o3":{"o4":{"o5":[[[[[]]]]]}}}}}', '{"Latitude":37.7668,"Longitude":-122.026020}',
    '[0,42,-42,3.14159,-3.14159,1.23e10,1.23e-10,12345678901234567890]', '["","\\"\\n\\t\\\\","\\u0041","\\uD83D\\uDE00"]', ' {"compact" : true , "with":"spaces"}\n',
    "9223372036854775807", "-9223372036854775808", "1e308", "1e-308", "0.0000000000000001", '"\u0416\u4e2d\u65e5\u0639"',
]
INVALID = {
    "01": "E_BAD_NUMBER", "1e": "E_BAD_NUMBER", ".1": "E_BAD_NUMBER", "1.": "E_BAD_NUMBER", '"a\x01b"': "E_BAD_TOKEN", '"open': "E_INCOMPLETE", '{"a" 1}': "E_BAD_TOKEN",
    '{"a":1 "b":2}': "E_BAD_TOKEN", "[1,2,3,]": "E_BAD_TOKEN", '{"a":1,}': "E_BAD_TOKEN", '"\\uD83D"': "E_BAD_UNICODE", '"\\uDE00"': "E_BAD_UNICODE", '"\\uDE00\\uD83D"': "E_BAD_UNICODE",
    "1 2": "E_TRAILING_GARBAGE", "NaN": "E_NONFINITE", "-Infinity": "E_NONFINITE", "": "E_INCOMPLETE", "[": "E_INCOMPLETE", '"\\q"': "E_BAD_ESCAPE", '{"a":1,"a":2}': "E_DUPKEY", "// c\n1": "E_BAD_TOKEN", "'a'": "E_BAD_TOKEN",
}
JSONC = ["// c\n1", "/* c */ [1, /* d */ 2,]", '{"a": 1, // x\n}']


@pytest.mark.parametrize("text", VALID)
def test_valid_round_trip(text):
    v = J.parse(text)
    assert J.equal(J.parse(J.write(v)), v, "LEXEME")
    assert J.equal(J.parse(J.write(v, JsonWriteOptions(pretty=True, sort_object_keys=True, escape_unicode=True))), v)


@pytest.mark.parametrize("text,code", INVALID.items())
def test_invalid(text, code):
    with pytest.raises(TextError) as e:
        J.parse(text)
    assert e.value.code == code


@pytest.mark.parametrize("text", JSONC)
def test_comments_and_trailing_commas(text):
    J.parse(text, JsonParseOptions.jsonc())
    with pytest.raises(TextError):
        J.parse(text)


def test_options():
    assert J.parse("[NaN,-Infinity]", JsonParseOptions(allow_nonfinite_numbers=True))[1].double == float("-inf")
    assert J.parse("['it\\'s']", JsonParseOptions(allow_single_quotes=True)) == ["it's"]
    assert J.parse('"a\tb"', JsonParseOptions(allow_unescaped_controls=True)) == "a\tb"
    assert J.parse("﻿1").lexeme == "1"
    for o in (JsonParseOptions(max_depth=2), JsonParseOptions(max_container_elems=2), JsonParseOptions(max_total_bytes=4), JsonParseOptions(allow_leading_bom=False)):
        with pytest.raises(TextError):
            J.parse("﻿[[[1,2,3]]]", o)
    assert J.parse("[" * 256 + "]" * 256)
    with pytest.raises(TextError) as e:
        J.parse("[" * 257 + "]" * 257)
    assert e.value.code == "E_DEPTH"


def test_error_place():
    with pytest.raises(TextError) as e:
        J.parse('{\n "é": x}')
    assert (e.value.line, e.value.col, e.value.offset) == (2, 7, 9) and e.value.snippet[e.value.caret] == "x"


def test_numbers():
    n = J.Number
    assert n("9223372036854775807").i64 == 2**63 - 1 and n("9223372036854775808").i64 is None and n("18446744073709551615").u64 == 2**64 - 1
    assert n("18446744073709551616").u64 is None and n("1.0").i64 is None and n("1e2").i64 is None and n("1e2").double == 100.0
    assert n("1e999").double is None and n("1e-999").double is None and n("0e-999").double == 0.0 and n("-1").u64 is None


def test_duplicate_policies():
    of = lambda policy, t='{"a":1,"b":0,"a":2}': J.write(J.parse(t, JsonParseOptions(dupkeys=policy)))
    assert (of("FIRST_WINS"), of("LAST_WINS"), of("COLLECT")) == ('{"a":1,"b":0}', '{"a":2,"b":0}', '{"a":[1,2],"b":0}')
    assert of("COLLECT", '{"a":[1],"a":2,"a":3}') == '{"a":[1,2,3]}'


def test_pointer_examples():
    doc = J.parse('{"foo":["bar","baz"],"":0,"a/b":1,"c%d":2,"e^f":3,"g|h":4,"i\\\\j":5,"k\\"l":6," ":7,"m~n":8,"0":9}')
    for p, v in {"/foo/0": '"bar"', "/": "0", "/a~1b": "1", "/c%d": "2", "/e^f": "3", "/g|h": "4", "/i\\j": "5", '/k"l': "6", "/ ": "7", "/m~0n": "8", "/0": "9"}.items():
        assert J.write(J.point(doc, p)) == v
    assert J.point(doc, "") is doc and J.point(doc, "/foo/2") is J.MISSING and J.point(doc, "/foo/01") is J.MISSING
    assert J.point(doc, "/0", "reference") is J.MISSING and J.point(doc, "/", "reference") is doc
    for bad in ("a", "/~2", "/~"):
        with pytest.raises(TextError):
            J.point(doc, bad)


def run(doc, ops):
    return J.write(J.patch(J.parse(doc), J.parse(ops)))


def test_patch():
    assert run('{"foo":["a","c"]}', '[{"op":"add","path":"/foo/1","value":"b"},{"op":"add","path":"/foo/-","value":"d"}]') == '{"foo":["a","b","c","d"]}'
    assert run('["a","b","c"]', '[{"op":"move","from":"/2","path":"/0"}]') == '["c","a","b"]'
    assert run('{"a":{"x":1}}', '[{"op":"copy","from":"/a","path":"/b"},{"op":"replace","path":"/b/x","value":2},{"op":"test","path":"/a/x","value":1.0}]') == '{"a":{"x":1},"b":{"x":2}}'
    root = J.parse('{"a":1}')
    for bad in ('[{"op":"remove","path":"/b"}]', '[{"op":"test","path":"/a","value":2}]', '[{"op":"x","path":""}]', '[{"op":"add","path":"/a"}]', '[{"op":"add","path":"/q/1","value":1}]', '{}',
                '[{"op":"replace","path":"/a","value":5},{"op":"remove","path":"/zz"}]'):
        with pytest.raises(TextError):
            J.patch(root, J.parse(bad))
        assert J.write(root) == '{"a":1}'
    with pytest.raises(TextError):
        run('{"a":{"b":1}}', '[{"op":"move","from":"/a","path":"/a/b"}]')


@pytest.mark.parametrize("a,b,c", [
    ('{"a":"b"}', '{"a":"c"}', '{"a":"c"}'), ('{"a":"b"}', '{"b":"c"}', '{"a":"b","b":"c"}'), ('{"a":"b"}', '{"a":null}', "{}"), ('{"a":["b"]}', '{"a":"c"}', '{"a":"c"}'),
    ('{"a":{"b":"c"}}', '{"a":{"b":"d","c":null}}', '{"a":{"b":"d"}}'), ('["a"]', '["c"]', '["c"]'), ('{"e":null}', '{"a":1}', '{"e":null,"a":1}'), ("[1,2]", '{"a":"b","c":null}', '{"a":"b"}'),
    ("{}", '{"a":{"bb":{"ccc":null}}}', '{"a":{"bb":{}}}'), ('{"a":"foo"}', "null", "null"),
])
def test_merge_patch_examples(a, b, c):
    assert J.write(J.merge_patch(J.parse(a), J.parse(b))) == c


def test_merge_and_equality():
    a, b = J.parse('{"x":1,"o":{"a":1}}'), J.parse('{"x":2,"o":{"a":3,"b":2}}')
    assert J.write(J.merge(a, b, "FIRST_WINS")) == '{"x":1,"o":{"a":1,"b":2}}' and J.write(J.merge(a, b)) == '{"x":2,"o":{"a":3,"b":2}}'
    with pytest.raises(TextError):
        J.merge(a, b, "ERROR")
    eq = lambda x, y, m="NUMERIC": J.equal(J.parse(x), J.parse(y), m)
    assert eq('{"a":1,"b":2}', '{"b":2,"a":1}') and eq("1", "1.0") and not eq("1", "1.0", "LEXEME") and not eq("[1,2]", "[2,1]") and not eq("1", '"1"')


def test_schema():
    s = lambda t, d: J.Schema(J.parse(t)).check(J.parse(d))
    s('{"type":"object","required":["a"],"properties":{"a":{"type":["number","null"],"minimum":1,"maximum":3}}}', '{"a":2}')
    s('{"const":1,"type":"string"}', "1.0")  # a const that holds is all
    for t, d in (('{"type":"string"}', "1"), ('{"required":["a"]}', "{}"), ('{"items":{"type":"number"}}', '[1,"a"]'), ('{"enum":[1,2]}', "3"), ('{"minimum":1}', "0"), ('{"maxLength":1}', '"é"'), ('{"minItems":1}', "[]"), ('{"const":1}', "2")):
        with pytest.raises(TextError) as e:
            s(t, d)
        assert e.value.code == "E_SCHEMA"
    with pytest.raises(TextError):
        J.Schema(J.parse('{"type":"integer"}'))


def test_writer():
    v = J.parse('{"b":[1,2],"a":{"x":"é😀/"}}')
    assert J.write(v, JsonWriteOptions(escape_unicode=True, escape_solidus=True, sort_object_keys=True)) == '{"a":{"x":"\\u00E9\\uD83D\\uDE00\\/"},"b":[1,2]}'
    assert J.write(v, JsonWriteOptions(pretty=True, inline_array_threshold=4, trailing_newline=True)) == '{\n  "b": [1, 2],\n  "a": {\n    "x": "é😀/"\n  }\n}\n'
    assert J.write(J.Number("1.50"), JsonWriteOptions(canonical_numbers=True)) == "1.5" and J.write(J.Number("1.50")) == "1.50"
    w = J.EventWriter()
    w.event("OBJECT_BEGIN")
    with pytest.raises(TextError):
        w.event("NUMBER", "1")
    w.event("KEY", "k")
    with pytest.raises(TextError):
        w.event("OBJECT_END")
    w.event("NUMBER", "1")
    with pytest.raises(TextError):
        w.finish()
    w.event("OBJECT_END")
    assert w.finish() == '{"k":1}'


def test_concatenated_values_and_nodes():
    assert [(a, b) for a, b, _ in J.parse_many(' 1 {"a":2}[3]')] == [(1, 2), (3, 10), (10, 13)]
    n = list(J.nodes(J.parse('{"a/b":[1,{"c":null}]}')))
    assert [x["path"] for x in n] == ["", "/a~1b", "/a~1b/0", "/a~1b/1", "/a~1b/1/c"] and n[2]["i64"] == 1 and n[4]["parent_id"] == 3


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(values)
def test_against_the_standard_library(v):
    text = json.dumps(v, ensure_ascii=False)
    assert json.loads(J.write(J.parse(text))) == v
    w = J.EventWriter()
    for kind, t in J.events(text):
        w.event(kind, t)
    assert json.loads(w.finish()) == v
    slow = J._Parser(text, JsonParseOptions())
    assert J.equal(slow.value(0), J.parse(text), "LEXEME")
