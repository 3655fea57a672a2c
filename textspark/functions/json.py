"""JSON functions on columns of JSON text.

Strict functions parse as ``json_model`` does and move batches by Arrow. A
null input gives null. ``*_result`` forms return struct<ok, value, error>; the
plain forms give null where the strict one fails. The node, value and event
tables are table functions.
"""

from __future__ import annotations

from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import JsonParseOptions, JsonWriteOptions, TextError, result_type
from . import json_model as J

NODE_TYPE = "node_id: int, parent_id: int, depth: int, ordinal: int, key: string, path: string, kind: string, lexeme: string, str: string, bool: boolean, i64: bigint, u64: decimal(20,0), dbl: double"


def strict(value_type: str, function, *columns) -> Column:
    """struct<ok, value, error> of a Python function over columns; an error is a value of the row, not of the job."""

    def run(*args):
        if any(a is None for a in args):
            return None
        try:
            return {"ok": True, "value": function(*args), "error": None}
        except TextError as e:
            return {"ok": False, "value": None, "error": e.row()}

    return F.udf(run, result_type(value_type), useArrow=True)(*columns)


def _text(v, o: JsonWriteOptions = JsonWriteOptions()) -> str:
    return J.write(v, o)


def _opt(v):
    return None if v is J.MISSING else J.write(v)


def parse_result(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    """The value as compact JSON text, lexemes and member order kept."""
    return strict("string", lambda t: _text(J.parse(t, options)), text)


def is_valid(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return parse_result(text, options)["ok"]


def write(text, write_options: JsonWriteOptions = JsonWriteOptions(), options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("string", lambda t: J.write(J.parse(t, options), write_options), text)["value"]


def variant_path(pointer: str) -> str | None:
    """A Variant path for a literal pointer, or None if Variant paths cannot say it."""
    out = "$"
    for t in J.tokens_of(pointer):
        if J.index_of(t) is not None or "'" in t or "\\" in t:
            return None  # a numeric token may be an index or a key
        out += f"['{t}']"
    return out


def pointer_get(text, pointer: str | Column, options: JsonParseOptions = JsonParseOptions(), trusted: bool = False, compat: str = "rfc") -> Column:
    """The JSON text at an RFC 6901 pointer, null if absent.

    ``trusted`` says that the text was written by a JSON writer with distinct
    keys; a literal pointer then stays in the JVM. Numbers may lose their
    lexeme there, and strings come as JSON text as well.
    """
    if trusted and isinstance(pointer, str) and (path := variant_path(pointer)):
        return F.to_json(F.try_variant_get(F.try_parse_json(text), path, "variant"))
    p = F.lit(pointer) if isinstance(pointer, str) else pointer
    return strict("string", lambda t, q: _opt(J.point(J.parse(t, options), q, compat)), text, p)["value"]


@lru_cache(maxsize=16)
def _known(text: str, options: JsonParseOptions):
    """A parsed patch, the same for all rows of a literal one; patches are read and never changed."""
    return J.parse(text, options)


def patch_result(text, patch, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("string", lambda t, p: _text(J.patch(J.parse(t, options), _known(p, options))), text, patch)


def patch(text, patch, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return patch_result(text, patch, options)["value"]


def merge_patch(text, patch, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("string", lambda t, p: _text(J.merge_patch(J.parse(t, options), _known(p, options))), text, patch)["value"]


def object_merge_result(a, b, policy: str = "LAST_WINS", options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("string", lambda x, y: _text(J.merge(J.parse(x, options), J.parse(y, options), policy)), a, b)


def equal(a, b, mode: str = "NUMERIC", options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("boolean", lambda x, y: J.equal(J.parse(x, options), J.parse(y, options), mode), a, b)["value"]


def schema_validate(text, schema: str, options: JsonParseOptions = JsonParseOptions()) -> Column:
    """struct<ok, value, error>; the schema is compiled once, on the driver, to see its errors early, and once a worker."""
    J.compiled(schema)

    def check(t):
        J.compiled(schema).check(J.parse(t, options))
        return True

    return strict("boolean", check, text)


def schema_column(variant: Column, schema: str) -> Column | None:
    """A flat schema as a predicate on a Variant, or None if it needs the strict validator.

    Covers objects whose properties have numeric bounds, so no Python runs.
    """
    doc = J.parse(schema)
    if set(doc) - {"type", "properties", "required"} or doc.get("type", "object") != "object":
        return None
    out = F.schema_of_variant(variant).startswith("OBJECT")
    for k in doc.get("required", []):
        out = out & F.try_variant_get(variant, f"$['{k}']", "variant").isNotNull()
    for k, s in doc.get("properties", {}).items():
        if set(s) - {"type", "minimum", "maximum"} or s.get("type") != "number" or "'" in k:
            return None
        v = F.try_variant_get(variant, f"$['{k}']", "double")
        ok = F.schema_of_variant(F.try_variant_get(variant, f"$['{k}']", "variant")).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")
        if "minimum" in s:
            ok = ok & (v >= s["minimum"].double)
        if "maximum" in s:
            ok = ok & (v <= s["maximum"].double)
        out = out & (F.try_variant_get(variant, f"$['{k}']", "variant").isNull() | ok)
    return out


def typeof(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return strict("string", lambda t: J.kind_of(J.parse(t, options)), text)["value"]


def _scalar(value_type: str, of, options):
    def get(text) -> Column:
        def run(t):
            v = of(J.parse(t, options))
            if v is None:
                raise TextError("E_INVALID", "the value is of another type")
            return v

        return strict(value_type, run, text)

    return get


def get_bool(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("boolean", lambda v: v if isinstance(v, bool) else None, options)(text)


def get_string(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("string", lambda v: v if isinstance(v, str) else None, options)(text)


def get_lexeme(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("string", lambda v: getattr(v, "lexeme", None), options)(text)


def get_i64(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("bigint", lambda v: getattr(v, "i64", None), options)(text)


def get_u64(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("decimal(20,0)", lambda v: None if getattr(v, "u64", None) is None else Decimal(v.u64), options)(text)


def get_double(text, options: JsonParseOptions = JsonParseOptions()) -> Column:
    return _scalar("double", lambda v: getattr(v, "double", None), options)(text)


def array_size(text) -> Column:
    return strict("int", lambda t: len(v) if isinstance(v := J.parse(t), list) else 0, text)["value"]


def object_size(text) -> Column:
    return strict("int", lambda t: len(v) if isinstance(v := J.parse(t), dict) else 0, text)["value"]


def array_get(text, index: int) -> Column:
    return strict("string", lambda t: J.write(v[index]) if isinstance(v := J.parse(t), list) and 0 <= index < len(v) else None, text)["value"]


def object_get(text, key: str) -> Column:
    return strict("string", lambda t: J.write(v[key]) if isinstance(v := J.parse(t), dict) and key in v else None, text)["value"]


def object_key(text, index: int) -> Column:
    return strict("string", lambda t: list(v)[index] if isinstance(v := J.parse(t), dict) and 0 <= index < len(v) else None, text)["value"]


def object_value(text, index: int) -> Column:
    return strict("string", lambda t: J.write(list(v.values())[index]) if isinstance(v := J.parse(t), dict) and 0 <= index < len(v) else None, text)["value"]


def _edit(kind: type, change):
    def run(t, *args):
        v = J.parse(t)
        if not isinstance(v, kind):
            raise TextError("E_INVALID", "the value is of another type")
        change(v, *args)
        return J.write(v)

    return run


def _index(v: list, i: int, most: int) -> int:
    if not 0 <= i < most:
        raise TextError("E_INVALID", "array index is out of range")
    return i


def array_push(text, value) -> Column:
    return strict("string", _edit(list, lambda v, x: v.append(J.parse(x))), text, value)


def array_set(text, index: int, value) -> Column:
    return strict("string", _edit(list, lambda v, x: v.__setitem__(_index(v, index, len(v)), J.parse(x))), text, value)


def array_insert(text, index: int, value) -> Column:
    return strict("string", _edit(list, lambda v, x: v.insert(_index(v, index, len(v) + 1), J.parse(x))), text, value)


def array_remove(text, index: int) -> Column:
    return strict("string", _edit(list, lambda v: v.pop(_index(v, index, len(v)))), text)


def object_put(text, key: str, value) -> Column:
    return strict("string", _edit(dict, lambda v, x: v.__setitem__(key, J.parse(x))), text, value)


def object_remove(text, key: str) -> Column:
    def gone(v):
        if key not in v:
            raise TextError("E_INVALID", f"key {key!r} is missing")
        del v[key]

    return strict("string", _edit(dict, gone), text)


def new_null() -> Column:
    return F.lit("null")


def new_bool(v: bool) -> Column:
    return F.lit("true" if v else "false")


def new_string(v: str) -> Column:
    return F.lit(J.quote(v))


def new_number(v) -> Column:
    """From an int, a float or a lexeme."""
    return F.lit(J.double_text(v) if isinstance(v, float) else str(v))


def new_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *items), F.lit("]"))


def new_object(**members: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(J.quote(k) + ":"), v) for k, v in members.items()]), F.lit("}"))


@F.udtf(returnType=NODE_TYPE)
class json_nodes:
    """The node table of a text; no rows for null or invalid texts."""

    def eval(self, text: str):
        if text is None:
            return
        try:
            value = J.parse(text)
        except TextError:
            return
        for n in J.nodes(value):
            if n["u64"] is not None:
                n["u64"] = Decimal(n["u64"])
            yield tuple(n.values())


@F.udtf(returnType="seq: int, start: bigint, end: bigint, value: string, code: string")
class json_values:
    """Concatenated values in order; the last row of a broken text has its error code."""

    def eval(self, text: str):
        if text is None:
            return
        seq = 0
        try:
            for start, end, v in J.parse_many(text):
                yield seq, start, end, J.write(v), None
                seq += 1
        except TextError as e:
            yield seq, e.offset, None, None, e.code


@F.udtf(returnType="seq: int, type: string, text: string, code: string")
class json_events:
    """Events of one value in order; the last row of a broken text has its error code."""

    def eval(self, text: str):
        if text is None:
            return
        seq = 0
        try:
            for kind, value in J.events(text):
                yield seq, kind, value, None
                seq += 1
        except TextError as e:
            yield seq, None, None, e.code


def from_events(events: DataFrame, doc: str = "doc_id", options: JsonWriteOptions = JsonWriteOptions()) -> DataFrame:
    """(doc, json result) from rows (doc, seq, type, text): one text for each document."""
    rows = events.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("seq", "type", "text"))).alias("events"))

    def fold(items):
        w = J.EventWriter(options)
        for e in items:
            w.event(e["type"], e["text"])
        return w.finish()

    return rows.select(doc, strict("string", fold, "events").alias("json"))


def resolve_duplicates(pairs: DataFrame, parent: list[str], policy: str = "LAST_WINS") -> DataFrame:
    """Rows (*parent, key, ordinal, value) under a duplicate policy, as grouped aggregates.

    LAST_WINS has the last value at the first ordinal; COLLECT has all values
    in order in ``values``; ERROR keeps all and flags them in ``duplicate``.
    """
    groups = pairs.groupBy(*parent, "key")
    if policy == "FIRST_WINS":
        return groups.agg(F.min("ordinal").alias("ordinal"), F.min_by("value", "ordinal").alias("value"))
    if policy == "LAST_WINS":
        return groups.agg(F.min("ordinal").alias("ordinal"), F.max_by("value", "ordinal").alias("value"))
    collected = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"])
    found = groups.agg(F.min("ordinal").alias("ordinal"), collected.alias("values"))
    return found if policy == "COLLECT" else found.withColumn("duplicate", F.size("values") > 1)


def sink_size(text) -> Column:
    return F.octet_length(text)


def sink_fixed(text, size: int) -> Column:
    """struct<data, used, truncated> of a sink that holds ``size`` bytes."""
    data = F.encode(text, "UTF-8")
    return F.struct(F.substring(data, 1, size).alias("data"), F.least(F.octet_length(text), F.lit(size)).alias("used"), (F.octet_length(text) > size).alias("truncated"))


def register(spark: SparkSession) -> None:
    """SQL names: json_strict, json_valid, json_pointer_get, json_patch, json_merge_patch, json_equal and the table functions."""
    def safe(f):
        def run(*args):
            if any(a is None for a in args):
                return None
            try:
                return f(*args)
            except TextError:
                return None

        return run

    for name, kind, f in (
        ("json_strict", "string", lambda t: J.write(J.parse(t))),
        ("json_pointer_get", "string", lambda t, p: _opt(J.point(J.parse(t), p))),
        ("json_patch", "string", lambda t, p: J.write(J.patch(J.parse(t), J.parse(p)))),
        ("json_merge_patch", "string", lambda t, p: J.write(J.merge_patch(J.parse(t), J.parse(p)))),
        ("json_object_merge", "string", lambda a, b, policy: J.write(J.merge(J.parse(a), J.parse(b), policy))),
        ("json_deep_equal", "boolean", lambda a, b: J.equal(J.parse(a), J.parse(b))),
        ("json_kind", "string", lambda t: J.kind_of(J.parse(t))),
    ):
        spark.udf.register(name, F.udf(safe(f), kind, useArrow=True))
    spark.udtf.register("json_nodes", json_nodes)
    spark.udtf.register("json_values", json_values)
    spark.udtf.register("json_events", json_events)
