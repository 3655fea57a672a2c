"""YAML functions on columns of YAML text; see ``yaml_model`` for the semantics.

A null input gives null. Errors are values of the row: ``*_result`` forms
return struct<ok, value, error>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import TextError, YamlParseOptions, YamlToJsonOptions, YamlWriteOptions
from . import json_model as J
from . import yaml_model as Y
from .json import strict

NODE_TYPE = (
    "doc_index: int, node_id: int, parent_id: int, depth: int, ordinal: int, key: string, role: string, path: string, kind: string, value: string, bool: boolean, "
    "i64: bigint, dbl: double, tag: string, anchor: string, alias_target_id: int, style: string, leading_comment: string, inline_comment: string, offset: bigint, line: bigint, col: bigint, bin: binary"
)
TIMESTAMP_TYPE = "struct<has_time:boolean,tz_specified:boolean,tz_utc:boolean,year:int,month:int,day:int,hour:int,minute:int,second:int,nsec:int,tz_offset:int>"


def to_json_result(text, options: YamlParseOptions = YamlParseOptions(), json_options: YamlToJsonOptions = YamlToJsonOptions()) -> Column:
    """The first document as JSON text."""
    return strict("string", lambda t: J.write(Y.to_json(Y.parse(t, options), json_options)), text)


def to_json(text, options: YamlParseOptions = YamlParseOptions(), json_options: YamlToJsonOptions = YamlToJsonOptions()) -> Column:
    return to_json_result(text, options, json_options)["value"]


def all_to_json(text, options: YamlParseOptions = YamlParseOptions(), json_options: YamlToJsonOptions = YamlToJsonOptions()) -> Column:
    """array<string>: every document of the stream as JSON text."""
    return strict("array<string>", lambda t: [J.write(Y.to_json(d, json_options)) for d in Y.parse_all(t, options)], text)["value"]


def is_valid(text, options: YamlParseOptions = YamlParseOptions()) -> Column:
    return strict("int", lambda t: len(Y.parse_all(t, options)), text)["ok"]


def document_count(text, options: YamlParseOptions = YamlParseOptions()) -> Column:
    return strict("int", lambda t: len(Y.parse_all(t, options)), text)["value"]


def has_merge_keys(text, options: YamlParseOptions = YamlParseOptions()) -> Column:
    return strict("boolean", lambda t: Y.parse(t, options).has_merge_keys, text)["value"]


def warnings(text, options: YamlParseOptions = YamlParseOptions()) -> Column:
    """array<struct<code, message>> of the first document's warnings."""
    return strict("array<struct<code:string,message:string>>", lambda t: [{"code": c, "message": m} for c, m in Y.parse(t, options).warnings], text)["value"]


def _node(value_type: str, of):
    def get(text, pointer: str | Column = "", options: YamlParseOptions = YamlParseOptions()) -> Column:
        def run(t, p):
            n = Y.point(Y.parse(t, options), p)
            return None if n is None else of(Y.deref(n))

        return strict(value_type, run, text, F.lit(pointer) if isinstance(pointer, str) else pointer)["value"]

    return get


kind = _node("string", lambda n: n.kind)
as_string = _node("string", lambda n: n.value if isinstance(n.value, str) else None)
as_bool = _node("boolean", lambda n: n.typed if n.kind == "bool" else None)
as_int = _node("bigint", lambda n: n.typed if n.kind == "int" else None)
as_float = _node("double", lambda n: n.typed if n.kind == "float" else None)
is_null = _node("boolean", lambda n: n.kind == "null")
as_binary = _node("binary", lambda n: n.typed if isinstance(n.typed, bytes) else None)
as_timestamp = _node(TIMESTAMP_TYPE, lambda n: n.typed if isinstance(n.typed, dict) else None)
size = _node("int", Y.size_of)
tag = _node("string", lambda n: n.tag)
style = _node("string", lambda n: n.style)
anchor = _node("string", lambda n: n.anchor)
leading_comment = _node("string", lambda n: n.leading_comment)
inline_comment = _node("string", lambda n: n.inline_comment)


def mapping_has_key(text, pointer: str, key: str, options: YamlParseOptions = YamlParseOptions()) -> Column:
    return strict("boolean", lambda t: Y.mapping_get(Y.point(Y.parse(t, options), pointer), key) is not None, text)["value"]


def write_result(text, write_options: YamlWriteOptions = YamlWriteOptions(), options: YamlParseOptions = YamlParseOptions()) -> Column:
    """The stream written again with write options."""
    def run(t):
        docs = Y.parse_all(t, options)
        return Y.write(docs[0], write_options) if len(docs) == 1 else Y.write_all(docs, write_options)

    return strict("string", run, text)


def edit(text, change, write_options: YamlWriteOptions = YamlWriteOptions(), options: YamlParseOptions = YamlParseOptions()) -> Column:
    """The first document after ``change(document)``, which edits it with the functions of ``yaml_model``."""
    def run(t):
        doc = Y.parse(t, options)
        change(doc)
        return Y.write(doc, write_options)

    return strict("string", run, text)


def mapping_set(text, pointer: str, key: str, value) -> Column:
    """Sets a key of the mapping at a pointer to a YAML text."""
    def run(t, v):
        doc = Y.parse(t)
        at = Y.deref(Y.point(doc, pointer))
        if at is None or at.kind != "mapping":
            raise TextError("E_INVALID", "no mapping at the pointer")
        Y.mapping_set(at, Y.new_scalar(key), Y.parse(v).root)
        return Y.write(doc)

    return strict("string", run, text, value)


def mapping_delete(text, pointer: str, key: str) -> Column:
    def change(doc):
        at = Y.deref(Y.point(doc, pointer))
        if at is None or at.kind != "mapping" or not Y.mapping_delete(at, key):
            raise TextError("E_INVALID", "no such key")

    return edit(text, change)


def sequence_insert(text, pointer: str, index: int, value) -> Column:
    """Inserts a YAML text into the sequence at a pointer; index -1 appends."""
    def run(t, v):
        doc = Y.parse(t)
        at = Y.deref(Y.point(doc, pointer))
        if at is None or at.kind != "sequence" or not Y.sequence_insert(at, len(at.value) if index == -1 else index, Y.parse(v).root):
            raise TextError("E_INVALID", "no such place")
        return Y.write(doc)

    return strict("string", run, text, value)


def sequence_remove(text, pointer: str, index: int) -> Column:
    def change(doc):
        at = Y.deref(Y.point(doc, pointer))
        if at is None or at.kind != "sequence" or not Y.sequence_remove(at, index):
            raise TextError("E_INVALID", "no such item")

    return edit(text, change)


@F.udtf(returnType=NODE_TYPE)
class yaml_nodes:
    """The node table of every document of a text; no rows for null or invalid texts."""

    def eval(self, text: str):
        if text is None:
            return
        try:
            rows = [n for d in Y.parse_all(text) for n in Y.nodes(d)]
        except TextError:
            return
        for n in rows:
            yield tuple(n.values())


@F.udtf(returnType="seq: int, type: string, value: string, tag: string, anchor: string, style: string, code: string")
class yaml_events:
    """Events of a stream in order; the last row of a broken text has its error code."""

    def eval(self, text: str):
        if text is None:
            return
        seq = 0
        try:
            for e in Y.events(text):
                yield (seq, *e, None)
                seq += 1
        except TextError as e:
            yield seq, None, None, None, None, None, e.code


@F.udtf(returnType="is_error: boolean, code: string, line: bigint, path: string, kind: string, value: string")
class yaml_partial:
    """What a broken text still has: node rows, and one row for each error."""

    def eval(self, text: str):
        if text is None:
            return
        doc, errors = Y.parse_partial(text)
        for n in Y.nodes(doc):
            yield False, None, n["line"], n["path"], n["kind"], n["value"]
        for e in errors:
            yield True, e.code, e.line, None, None, None


def from_events(events: DataFrame, doc: str = "doc_id", options: YamlWriteOptions = YamlWriteOptions()) -> DataFrame:
    """(doc, yaml result) from rows (doc, seq, type, value, tag, anchor, style)."""
    rows = events.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "type", "value", "tag", "anchor", "style"))).alias("events"))

    def fold(items):
        w = Y.EventWriter(options)
        for e in items:
            w.event(e["type"], e["value"], e["tag"], e["anchor"], e["style"])
        return w.finish()

    return rows.select(doc, strict("string", fold, "events").alias("yaml"))


def plain_kind(value: Column, yaml_1_1: bool = False) -> Column:
    """Kind of a plain scalar under the core schema, as JVM expressions only."""
    low = F.lower(value)
    digits = F.regexp_replace(value, "_", "")
    wide = F.regexp_replace(digits, "^[+-]", "")
    integer = value.rlike(r"\A[+-]?(0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|0|[1-9][0-9_]*)\z")
    fits = F.when(wide.rlike("^0[box]"), F.length(wide) <= 17).otherwise(F.try_to_number(F.lpad(wide, 19, "0"), F.lit("0" * 19)).isNotNull() & (F.length(wide) <= 19) & digits.try_cast("bigint").isNotNull())
    number = value.rlike(r"\A[+-]?(\.[0-9][0-9_]*|[0-9][0-9_]*(\.[0-9_]*)?)([eE][+-]?[0-9]+)?\z") & value.rlike("[.eE]") | low.rlike(r"\A([+-]?\.inf|\.nan)\z")
    booleans = ("true", "false", "yes", "no", "on", "off", "y", "n") if yaml_1_1 else ("true", "false")
    return (
        F.when(low.isin("~", "null", ""), "null").when(low.isin(*booleans), "bool").when(integer & fits, "int").when(number, "float").otherwise("string")
    )


def register(spark: SparkSession) -> None:
    """SQL names: yaml_to_json, yaml_kind and the table functions."""
    def safe(f):
        def run(*args):
            if any(a is None for a in args):
                return None
            try:
                return f(*args)
            except TextError:
                return None

        return run

    spark.udf.register("yaml_to_json", F.udf(safe(lambda t: J.write(Y.to_json(Y.parse(t)))), "string", useArrow=True))
    spark.udf.register("yaml_kind", F.udf(safe(lambda t, p: getattr(Y.deref(Y.point(Y.parse(t), p)), "kind", None)), "string", useArrow=True))
    for u in (yaml_nodes, yaml_events, yaml_partial):
        spark.udtf.register(u.func.__name__, u)
