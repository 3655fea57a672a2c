"""Functions on columns: nulls, errors as values, SQL names, streaming in any cut."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textspark.functions import json as TJ
from textspark.functions import yaml as TY
from textspark.streaming.chunks import parse_chunks, parse_chunks_batch


def test_nulls_and_errors(spark):
    df = spark.createDataFrame([(None,), ("",), ("{",), ('{"a":[1,2]}',)], "t string").withColumn("i", F.monotonically_increasing_id())
    r = df.select("i", TJ.parse_result("t").alias("r"), TJ.typeof("t").alias("k"), TJ.pointer_get("t", "/a/1").alias("p")).orderBy("i").collect()
    assert r[0].r is None and [x.r.ok for x in r[1:]] == [False, False, True] and [x.r.error.code for x in r[1:3]] == ["E_INCOMPLETE"] * 2
    assert [x.k for x in r] == [None, None, None, "object"] and r[3].p == "2"
    y = df.select("i", TY.is_valid("t").alias("v"), TY.to_json_result(F.lit("a: *x"))["error"]["code"].alias("c")).orderBy("i").collect()
    assert [x.v for x in y] == [None, True, False, True] and y[0].c == "E_INVALID"
    from textspark.core import YamlParseOptions

    w = spark.range(1).select(TY.warnings(F.lit("a: 1\na: 2"), YamlParseOptions(dupkeys="LAST_WINS")).alias("w")).first().w
    assert [x.code for x in w] == ["DUPKEY"]


def test_sql_names(spark):
    TJ.register(spark)
    TY.register(spark)
    row = spark.sql("""SELECT json_pointer_get('{"a":1}', '/a') p, json_merge_patch('{"a":1}', '{"a":null}') m, json_deep_equal('1', '1.0') e, yaml_to_json('a: 1') y, json_strict('[1,') s""").first()
    assert tuple(row) == ("1", "{}", True, '{"a":1}', None)
    assert spark.sql("SELECT path FROM json_nodes('[1,[2]]') ORDER BY node_id").collect()[2].path == "/1"
    assert spark.sql("SELECT type FROM yaml_events('- a')").count() == 7
    assert spark.sql("SELECT count(*) c FROM yaml_partial('a: 1\nb: [')").first().c >= 2


def test_plain_kind_equals_model(spark):
    from textspark.functions import yaml_model as Y

    words = ["", "~", "NULL", "true", "False", "yes", "0", "-12", "007", "1_000", "0x1F", "0o17", "9223372036854775807", "9223372036854775808", "1.5", ".5", "1e3", "1.", ".inf", "-.INF", ".nan", "abc", "1.2.3", "--1"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", TY.plain_kind(F.col("w")).alias("k")).collect()
    for r in got:
        n = Y.resolve(Y.Document(Y.Node("null" if r.w == "" else "string", r.w))).root
        assert n.kind == r.k, r.w


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 7), st.randoms())
def test_any_cut_gives_the_whole(spark, size, rnd):
    docs = {"1": '{"a":[1,2.50,"é😀"],"b":{"c":null}}', "2": "[1,2", "3": '"x"'}
    rows = [(d, i, t[i * size : (i + 1) * size], (i + 1) * size >= len(t)) for d, t in docs.items() for i in range(-(-len(t) // size))]
    rnd.shuffle(rows)
    got = {r.doc_id: (r.ok, r.value, r.code) for r in parse_chunks_batch(spark.createDataFrame(rows, "doc_id string, chunk_no int, text string, is_last boolean")).collect()}
    assert got == {"1": (True, docs["1"], None), "2": (False, None, "E_INCOMPLETE"), "3": (True, '"x"', None)}


@pytest.mark.parametrize("kind,text,value", [("json", '{"a": [1, 2]}', '{"a":[1,2]}'), ("csv", "a,b\n1,\"x\ny\"\n", '[["a","b"],["1","x\\ny"]]'), ("yaml", "a:\n- 1\n", '{"a":[1]}')])
def test_stream(spark, tmp_path, kind, text, value):
    source = tmp_path / "in"
    schema = "doc_id string, chunk_no int, text string, is_last boolean"
    parts = [("d", i, text[i * 4 : i * 4 + 4], i * 4 + 4 >= len(text)) for i in range(-(-len(text) // 4))]
    spark.createDataFrame(parts[::-1], schema).coalesce(1).write.json(str(source))
    spark.createDataFrame([("open", 0, "[", False)], schema).write.mode("append").json(str(source))
    name = f"chunks_{kind}"
    q = parse_chunks(spark.readStream.schema(schema).json(str(source)), kind, timeout=None).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.doc_id, r.ok, r.value) for r in spark.table(name).collect()] == [("d", True, value)]
