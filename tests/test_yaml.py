"""YAML: structure against an independent parser, resolution, policies, writer, conversion."""

import pytest
import yaml as other

from textspark.core import CustomTag, TextError, YamlParseOptions, YamlToJsonOptions, YamlWriteOptions
from textspark.functions import json_model as J
from textspark.functions import yaml_model as Y

SAME = [
    "- a\n- b: c\n  d: e\n-\n  - x\n- ! x\n", "key: &a\n  x: 1\nother: *a\nz: [*a, 1]\n", "plain\n multi\n line\n", "{a: 1, b: , c}", "[a: 1, b]", "a:\n- 1\n- 2\nb:\n",
    "--- \na: 1\n...\n---\nb: 2\n", "# c\na: 1 # inline\n# lead\nb: 2\n", '"q": "multi\n  line\n\n  x"\n', 'x: !!str 12\ny: !!int "42"\nw: !!float 3\n', "a: >+\n  x\n\nb: 1", "a: 'x'\n\nb: \"\"\nc: ''\n",
    'services:\n  web:\n    image: "nginx:1.2"\n    ports:\n      - "80:80"\n    env: {A: b, C: "d"}\n  db:\n    command: ["a", "-c", \'d e\']\n',
    "apiVersion: v1\nkind: Pod\nmetadata:\n  labels: {app: x}\nspec:\n  containers:\n  - name: c\n    args: [--flag=1, -v]\n    ports:\n    - containerPort: 80\n",
    "a: -5\nb: 0.25\nc: true\nd: ~\ne: null\n", "a: b\\c\nurl: http://x.y/z#frag\nt: 50%\nd: a - b, c\n", "- |-\n  x\n   y\n- >-\n  one\n  two\n\n  three\n",
]


@pytest.mark.parametrize("text", SAME)
def test_like_an_independent_parser(text):
    docs = Y.parse_all(text)
    assert [Y.plain_value(d.root) for d in docs] == list(other.safe_load_all(text))
    again = Y.parse_all(Y.write_all(docs))
    assert [Y.plain_value(d.root) for d in again] == [Y.plain_value(d.root) for d in docs]
    w = Y.EventWriter()
    for e in Y.events(text):
        w.event(*e)
    assert [Y.plain_value(d.root) for d in Y.parse_all(w.finish())] == [Y.plain_value(d.root) for d in docs]


def value(text, **o):
    return Y.plain_value(Y.parse(text, YamlParseOptions(**o)).root)


@pytest.mark.parametrize("head,tail,expected", [("|", "", "a\nb"), ("|+", "\n", "a\nb\n\n"), ("|-", "\n", "a\nb"), (">", "", "a b"), ("|1", "", " a\n b")])
def test_chomping(head, tail, expected):
    assert value(f"{head}\n  a\n  b\n{tail}") == expected


def test_typing():
    for text, kind, v in (("42", "int", 42), ("0x1F", "int", 31), ("0o17", "int", 15), ("0b11", "int", 3), ("1_000", "int", 1000), ("007", "string", "007"), ("9223372036854775808", "string", "9223372036854775808"), ("1e3", "float", 1000.0), (".inf", "float", float("inf")), ("TRUE", "bool", True), ("yes", "string", "yes"), ("'3.8'", "string", "3.8"), ("12:30", "string", "12:30")):
        n = Y.parse(text).root
        assert (n.kind, Y.plain_value(n)) == (kind, v), text
    assert value("yes", yaml_1_1=True) is True and value("1:30", yaml_1_1=True) == 90 and value("010", yaml_1_1=True) == 8
    assert value("True", schema="JSON") == "True" and value("1", schema="FAILSAFE") == "1" and value("a: 1", mode="CONFIG") == {"a": "1"}
    stamp = Y.parse("!!timestamp 2025-02-14T10:30:45.5+01:30").root.typed
    assert (stamp["nsec"], stamp["tz_offset"], stamp["second"]) == (500_000_000, 90, 45)
    assert Y.parse("!!binary aGk=").root.typed == b"hi"
    for bad in ("!!int x", "!!timestamp 2025-02-30", "!!binary '*'", "!!set {a: 1}", "!!omap [{a: 1}, {a: 2}]", "a: *x", "!q!x y"):
        with pytest.raises(TextError):
            Y.parse(bad)
    assert Y.parse("!!set {a, b}").root.kind == "set" and Y.plain_value(Y.parse("!!pairs [{a: 1}, {a: 2}]").root) == [("a", 1), ("a", 2)]


def test_merge_and_duplicates():
    assert value("d: &d {a: 1, b: 2}\nc: {<<: *d, b: 3, c: 4}")["c"] == {"a": 1, "b": 3, "c": 4}
    assert value("x: &x {b: 1}\ny: &y {b: 2}\nc: {<<: [*x, *y], d: 5}")["c"] == {"b": 2, "d": 5}
    for policy, v in (("FIRST_WINS", 1), ("LAST_WINS", 2)):
        assert value("a: 1\na: 2", dupkeys=policy) == {"a": v}
    with pytest.raises(TextError):
        value("true: 1\nTRUE: 2")
    with pytest.raises(TextError):
        value("a: &a 1\nb: {<<: 3}")


def test_limits_and_modes():
    bomb = "a: &a [x,x,x,x,x,x,x,x,x]\n" + "".join(f"{c}: &{c} [{','.join(['*' + p] * 9)}]\n" for p, c in zip("abcdefgh", "bcdefghi", strict=True))
    for text, o in ((bomb, YamlParseOptions()), ("[" * 300 + "]" * 300, YamlParseOptions()), ("a: 1", YamlParseOptions(max_total_bytes=2)), ("a: &a 1\nb: *a", YamlParseOptions.safe()), ("? [a]\n: b", YamlParseOptions.safe()), ("1: a", YamlParseOptions.safe()), ("a: !x 1", YamlParseOptions.safe()), ("\ta: 1", YamlParseOptions()), ("a: 1\n b: 2", YamlParseOptions()), ('"\\xZZ"', YamlParseOptions()), ('a: "x', YamlParseOptions())):
        with pytest.raises(TextError):
            Y.parse(text, o)
    assert Y.parse("- &a [*b]" if False else "x").root.value == "x"


def test_accessors_and_edits():
    doc = Y.parse("# top\na: 1 # one\nb: [x, y]\nc: &k {d: true}\ne: *k\n")
    root = doc.root
    assert Y.size_of(root) == 4 and Y.mapping_get(root, "a").inline_comment == "one" and Y.point(doc, "/b/1").value == "y" and Y.point(doc, "/e/d").typed is True
    assert Y.mapping_get(root, "zz") is None and Y.mapping_get(Y.parse("1: x").root, "1") is None
    assert (Y.point(doc, "/b").line, Y.point(doc, "/b").col) == (3, 4)
    Y.mapping_set(root, Y.new_scalar("a"), Y.new_scalar("new"))
    assert Y.sequence_insert(Y.point(doc, "/b"), 2, Y.new_scalar("z")) and not Y.sequence_remove(Y.point(doc, "/b"), 9) and Y.mapping_delete(root, "e")
    copy = Y.clone(root)
    Y.set_typed(Y.point(doc, "/c/d"), 7)
    assert Y.plain_value(root) == {"a": "new", "b": ["x", "y", "z"], "c": {"d": 7}} and Y.plain_value(copy)["c"] == {"d": True}


@pytest.mark.parametrize("text,options,expected", [
    ("items: [a, b]\nsettings: {key: value}", {"flow_style": "BLOCK"}, "items:\n  - a\n  - b\nsettings:\n  key: value"),
    ("items:\n  - a\n  - b\nsettings:\n  key: value", {"flow_style": "FLOW"}, "{items: [a, b], settings: {key: value}}"),
    ("items:\n- a", {"indent_spaces": 4}, "items:\n    - a"), ("hello world", {"scalar_style": "SINGLE_QUOTED"}, "'hello world'"), ('"line 1\\nline 2\\n"', {"scalar_style": "LITERAL"}, "|+\n  line 1\n  line 2"),
    ("one two three", {"scalar_style": "FOLDED", "line_width": 5}, ">\n  one\n  two\n  three"), ("a: 1\nb: 2", {"newline": "\r\n"}, "a: 1\r\nb: 2"), ("hello", {"trailing_newline": True}, "hello\n"),
    ("a: '123'\nb: 'true'\nc: ''", {}, "a: '123'\nb: 'true'\nc: ''"), ("x: &a [1]\ny: *a", {"flow_style": "FLOW"}, "{x: &a [1], y: *a}"),
])
def test_writer(text, options, expected):
    assert Y.write(Y.parse(text), YamlWriteOptions(**options)) == expected


def test_to_json():
    of = lambda t, **o: J.write(Y.to_json(Y.parse(t), YamlToJsonOptions(**o)))
    assert of("a: [1, 2.50, x, null, true]\nb: {c: 'd'}") == '{"a":[1,2.50,"x",null,true],"b":{"c":"d"}}'
    for bad in ("a: &x 1\nb: *x", "d: &d {a: 1}\nc: {<<: *d}", "1: a", "9007199254740993", "!!set {a}", ".inf"):
        with pytest.raises(TextError):
            of(bad)
    assert of("a: &x 1\nb: *x", allow_resolved_aliases=True) == '{"a":1,"b":1}' and of("1: a", coerce_keys_to_strings=True) == '{"1":"a"}'
    assert of("9007199254740993", large_int_policy="STRING") == '"9007199254740993"' and of("9007199254740993", large_int_policy="DOUBLE") == "9007199254740992"
    assert Y.plain_value(Y.parse_json('{"a":[1,"x"]}').root) == {"a": [1, "x"]}


def test_tags_partial_encodings():
    up = CustomTag("!up", construct=str.upper, to_json=lambda n: n.typed)
    doc = Y.parse("a: !up hi", YamlParseOptions(enable_custom_tags=True, custom_tags=(up,)))
    assert J.write(Y.to_json(doc, YamlToJsonOptions(custom_tags=(up,)))) == '{"a":"HI"}'
    assert Y.parse("%TAG !e! tag:e,2000:\n---\n!e!x y").root.tag == "tag:e,2000:x"
    doc, errors = Y.parse_partial("a: 1\nb: [\nc: 2\n")
    assert errors and Y.plain_value(doc.root).get("a") == 1
    for name in ("utf-8-sig", "utf-16", "utf-32"):
        assert Y.decoded("a: é".encode(name)) == "a: é"
    assert Y.encoded("é", YamlWriteOptions(encoding="utf-16-le", emit_bom=True)) == b"\xff\xfe\xe9\x00"
    assert [d.index for d in Y.parse_all("a\n---\nb\n")] == [0, 1] and Y.parse("").root is None
