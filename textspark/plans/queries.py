"""The library's own queries over the supplied tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import CsvWriteOptions, JsonParseOptions, JsonWriteOptions, YamlParseOptions, YamlToJsonOptions
from ..functions import json as TJ
from ..functions import yaml as TY
from ..operators import csv_table as TC
from ..operators.csv_table import CsvTable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", "event_type", "props")


K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT event_type, count(*) AS n, CAST(sum({K}) AS BIGINT) AS total FROM events GROUP BY event_type")
def flagship(spark, sf_dir):
    """Events by type with a JSON member summed; the pointer is literal and the text trusted, so all of it stays in the JVM."""
    k = TJ.pointer_get(F.col("props"), "/k", trusted=True).cast("bigint")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_pointer_get(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", TJ.pointer_get("props", "/k").alias("k"))


@query("SELECT event_id, props AS canon, true AS ok FROM (SELECT event_id, replace(props, ': ', ':') AS props FROM events)")
def json_parse(spark, sf_dir):
    r = _events(spark, sf_dir).select("event_id", TJ.parse_result("props").alias("r"))
    return r.select("event_id", F.col("r.value").alias("canon"), F.col("r.ok").alias("ok"))


@query("SELECT event_id, 'object' AS kind, 'number' AS k_kind, 1 AS size, 'k' AS first_key, 0 AS n_items FROM events")
def json_accessors(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", TJ.typeof("props").alias("kind"), TJ.typeof(TJ.object_get("props", "k")).alias("k_kind"), TJ.object_size("props").alias("size"), TJ.object_key("props", 0).alias("first_key"), TJ.array_size("props").alias("n_items"))


@query(f"SELECT event_id, {K} AS i64, CAST({K} AS DECIMAL(20,0)) AS u64, CAST({K} AS DOUBLE) AS dbl, CAST({K} AS VARCHAR) AS lexeme FROM events")
def json_numbers(spark, sf_dir):
    k = TJ.object_get("props", "k")
    return _events(spark, sf_dir).select("event_id", TJ.get_i64(k)["value"].alias("i64"), TJ.get_u64(k)["value"].alias("u64"), TJ.get_double(k)["value"].alias("dbl"), TJ.get_lexeme(k)["value"].alias("lexeme"))


@query(f"""SELECT event_id, 0 AS node_id, CAST(NULL AS INTEGER) AS parent_id, '' AS path, 'object' AS kind, CAST(NULL AS BIGINT) AS i64 FROM events
UNION ALL SELECT event_id, 1, 0, '/k', 'number', {K} FROM events""")
def json_nodes(spark, sf_dir):
    return _events(spark, sf_dir).lateralJoin(TJ.json_nodes(F.col("props").outer())).select("event_id", "node_id", "parent_id", "path", "kind", "i64")


@query(f"""SELECT event_id, 0 AS seq, CAST({K} AS VARCHAR) AS value FROM events
UNION ALL SELECT event_id, 1, '[' || event_id || ']' FROM events""")
def json_values(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("text", F.concat(F.get_json_object("props", "$.k"), F.lit(" ["), "event_id", F.lit("]")))
    return e.lateralJoin(TJ.json_values(F.col("text").outer())).select("event_id", "seq", "value")


@query(f"""SELECT event_id, '{{"k":' || {K} || '}}' AS json FROM events""")
def json_events_round_trip(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.lateralJoin(TJ.json_events(F.col("props").outer())).select("event_id", "seq", "type", "text")
    return TJ.from_events(rows, "event_id").select("event_id", F.col("json.value").alias("json"))


@query("""SELECT event_id, '{"src":"x"}' AS merged FROM events""")
def json_merge_patch(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", TJ.merge_patch("props", F.lit('{"k":null,"src":"x"}')).alias("merged"))


@query(f"""SELECT event_id, '{{"k":' || {K} || ',"a":[1,2]}}' AS added, '{{}}' AS removed, '{{"k":"z"}}' AS replaced, '{{"m":' || {K} || '}}' AS moved,
'{{"k":' || {K} || ',"c":' || {K} || '}}' AS copied, CASE WHEN {K} = 5 THEN 'ok' ELSE 'E_INVALID' END AS tested FROM events""")
def json_patch(spark, sf_dir):
    def p(*ops):
        return TJ.patch("props", F.lit("[" + ",".join(ops) + "]"))

    tested = TJ.patch_result("props", F.lit('[{"op":"test","path":"/k","value":5}]'))
    return _events(spark, sf_dir).select(
        "event_id",
        p('{"op":"add","path":"/a","value":[2]}', '{"op":"add","path":"/a/0","value":1}').alias("added"),
        p('{"op":"remove","path":"/k"}').alias("removed"),
        p('{"op":"replace","path":"/k","value":"z"}').alias("replaced"),
        p('{"op":"move","from":"/k","path":"/m"}').alias("moved"),
        p('{"op":"copy","from":"/k","path":"/c"}').alias("copied"),
        F.coalesce(tested["error"]["code"], F.lit("ok")).alias("tested"),
    )


@query(f"SELECT event_id, {K} BETWEEN 10 AND 50 AS valid, {K} BETWEEN 10 AND 50 AS valid_jvm FROM events")
def json_schema_validate(spark, sf_dir):
    schema = '{"type":"object","required":["k"],"properties":{"k":{"type":"number","minimum":10,"maximum":50}}}'
    fast = TJ.schema_column(F.try_parse_json("props"), schema)
    return _events(spark, sf_dir).select("event_id", TJ.schema_validate("props", schema)["ok"].alias("valid"), fast.alias("valid_jvm"))


@query(f"""SELECT event_id, '{{"k":' || {K} || '}}' AS first, '{{"k":' || event_id || '}}' AS last, '{{"k":[' || {K} || ',' || event_id || ']}}' AS collected, 'E_DUPKEY' AS error FROM events""")
def json_duplicate_keys(spark, sf_dir):
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"k":'), "event_id", F.lit("}"))
    of = lambda policy: TJ.parse_result("text", JsonParseOptions(dupkeys=policy))["value"]
    return _events(spark, sf_dir).withColumn("text", text).select("event_id", of("FIRST_WINS").alias("first"), of("LAST_WINS").alias("last"), of("COLLECT").alias("collected"), TJ.parse_result("text")["error"]["code"].alias("error"))


@query("""SELECT c_nationkey AS nation, c_mktsegment AS key, min(c_custkey) AS ordinal, max_by(c_name, c_custkey) AS value FROM customer GROUP BY ALL""")
def json_resolve_duplicates(spark, sf_dir):
    pairs = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("value"))
    return TJ.resolve_duplicates(pairs, ["nation"], "LAST_WINS").select("nation", "key", "ordinal", "value")


@query("SELECT event_id, false AS lexeme, true AS numeric, true AS same FROM events")
def json_equal(spark, sf_dir):
    other = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(".0}"))
    return _events(spark, sf_dir).withColumn("other", other).select("event_id", TJ.equal("props", "other", "LEXEME").alias("lexeme"), TJ.equal("props", "other").alias("numeric"), TJ.equal("props", "props", "LEXEME").alias("same"))


@query("""SELECT n_nationkey, '{"a":' || n_regionkey || ',"n":' || n_nationkey || '}' AS sorted,
'{' || chr(10) || '  "n": ' || n_nationkey || ',' || chr(10) || '  "a": ' || n_regionkey || chr(10) || '}' AS pretty, CAST(n_nationkey AS VARCHAR) AS canonical FROM nation""")
def json_write(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").withColumn("text", F.to_json(F.struct(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("a"))))
    return n.select("n_nationkey", TJ.write("text", JsonWriteOptions(sort_object_keys=True)).alias("sorted"), TJ.write("text", JsonWriteOptions(pretty=True)).alias("pretty"), TJ.write(TJ.object_get("text", "n"), JsonWriteOptions(canonical_numbers=True)).alias("canonical"))


@query(f"""SELECT event_id, '[' || {K} || ',7]' AS pushed, '[9]' AS set_item, '[8,' || {K} || ']' AS inserted, '[]' AS removed, '{{"k":1,"z":2}}' AS put, '{{}}' AS dropped FROM events""")
def json_edits(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("arr", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]")))
    return e.select(
        "event_id", TJ.array_push("arr", F.lit("7"))["value"].alias("pushed"), TJ.array_set("arr", 0, F.lit("9"))["value"].alias("set_item"), TJ.array_insert("arr", 0, F.lit("8"))["value"].alias("inserted"),
        TJ.array_remove("arr", 0)["value"].alias("removed"), TJ.object_put(TJ.object_put("props", "k", F.lit("1"))["value"], "z", F.lit("2"))["value"].alias("put"), TJ.object_remove("props", "k")["value"].alias("dropped"),
    )


@query(f"""SELECT event_id, '{{"k":' || {K} || ',"o":{{"a":1,"b":2}}}}' AS first, '{{"k":0,"o":{{"a":9,"b":2}}}}' AS last, 'E_DUPKEY' AS error FROM events""")
def json_object_merge(spark, sf_dir):
    a = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"o":{"a":1}}'))
    b = F.lit('{"k":0,"o":{"a":9,"b":2}}')
    return _events(spark, sf_dir).withColumn("a", a).select("event_id", TJ.object_merge_result("a", b, "FIRST_WINS")["value"].alias("first"), TJ.object_merge_result("a", b, "LAST_WINS")["value"].alias("last"), TJ.object_merge_result("a", b, "ERROR")["error"]["code"].alias("error"))


@query("SELECT doc_id, octet_length(encode(text)) + 0 AS size, least(octet_length(encode(text)), 64) AS used, octet_length(encode(text)) > 64 AS truncated FROM documents")
def sinks(spark, sf_dir):
    s = TJ.sink_fixed(F.col("text"), 64)
    return _table(spark, sf_dir, "documents").select("doc_id", TJ.sink_size("text").cast("bigint").alias("size"), s["used"].cast("bigint").alias("used"), s["truncated"].alias("truncated"))


@query("SELECT p_partkey, 2 AS n_rows, p_name AS name, p_brand AS brand FROM part")
def csv_parse(spark, sf_dir):
    line = F.concat(F.lit("k,name,brand\n"), "p_partkey", F.lit(',"'), F.replace("p_name", F.lit('"'), F.lit('""')), F.lit('",'), "p_brand", F.lit("\n"))
    rows = TC.parse_column("line")["value"]
    return _table(spark, sf_dir, "part").withColumn("line", line).withColumn("rows", rows).select("p_partkey", F.size("rows").alias("n_rows"), F.col("rows")[1][1].alias("name"), F.col("rows")[1][2].alias("brand"))


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || ',' || CASE WHEN text = '' OR contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || lang AS line FROM documents""")
def csv_write_lines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", TC.line_text(F.array(F.col("doc_id").cast("string"), "text", "lang"), CsvWriteOptions()).alias("line"))


@query("SELECT doc_id, text AS field FROM documents")
def csv_round_trip(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    line = TC.line_text(F.array(F.col("doc_id").cast("string"), "text"))
    return d.select("doc_id", TC.parse_column(line)["value"][0][1].alias("field"))


def _nations(spark, sf_dir) -> CsvTable:
    return CsvTable.of(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


NATION = "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_index, CAST(n_nationkey AS VARCHAR) AS k, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation"


def _cells(t: CsvTable, *names: str) -> DataFrame:
    return t.rows.select("row_index", *[F.get("fields", F.lit(i)).alias(n) for i, n in enumerate(names)])


@query(f"""WITH n AS ({NATION}) SELECT row_index, k, name, region FROM n WHERE row_index < 2
UNION ALL SELECT 2, 'x', 'new', '' UNION ALL SELECT row_index + 1, k, CASE WHEN row_index = 5 THEN 'set' ELSE name END, region FROM n WHERE row_index >= 2 AND row_index < 20
UNION ALL SELECT row_index, k, name, region FROM n WHERE row_index > 20 UNION ALL SELECT (SELECT count(*) FROM n), 'y', 'last', 'r'""")
def csv_rows(spark, sf_dir):
    """Insert at 2, set a cell, remove the old row 20, append."""
    t = _nations(spark, sf_dir).row_insert(2, ["x", "new", ""]).field_set(6, 1, "set").row_remove(21)
    return _cells(t.row_append(["y", "last", "r"]), "k", "name", "region")


@query(f"WITH n AS ({NATION}) SELECT row_index, name, '' AS blank, region, 'v' || row_index AS v FROM n")
def csv_columns(spark, sf_dir):
    t = _nations(spark, sf_dir).column_insert(2, "blank").column_remove(0)
    values = t.rows.select("row_index", F.concat(F.lit("v"), F.col("row_index").cast("string")).alias("value"))
    t = t.column_append_with_values("v", values).column_rename(0, "name")
    return _cells(t, "name", "blank", "region", "v")


@query("""SELECT c_custkey, len(f) AS width, list_resize(f, 4, '') AS padded FROM (SELECT c_custkey, [x for x in ['a', c_name, c_mktsegment, 'd'] if true][1:1 + c_custkey % 4] AS f FROM customer)""")
def csv_normalize(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    ragged = F.slice(F.array(F.lit("a"), "c_name", "c_mktsegment", F.lit("d")), F.lit(1), (F.col("c_custkey") % 4).cast("int") + 1)
    t = CsvTable(c.select(F.col("c_custkey").alias("row_index"), ragged.alias("fields")), allow_irregular_rows=True)
    wide = t.normalize_to_max().rows.withColumnRenamed("fields", "padded")
    return t.rows.join(wide, "row_index").select(F.col("row_index").alias("c_custkey"), F.size("fields").cast("bigint").alias("width"), "padded")


@query("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '","region":"' || r_name || '","tags":["a","b"],"none":null}' AS json FROM nation JOIN region ON n_regionkey = r_regionkey""")
def yaml_to_json(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit("id: "), "n_nationkey", F.lit("\nname: "), "n_name", F.lit('\nregion: "'), "r_name", F.lit('"\ntags:\n  - a\n  - b\nnone:\n'))
    return n.select("n_nationkey", TY.to_json(text).alias("json"))


@query("""SELECT n_nationkey, 'int' AS id_kind, 'string' AS name_kind, 'string' AS quoted_kind, 'float' AS float_kind, 'bool' AS bool_kind, 'null' AS null_kind, CAST(n_nationkey AS BIGINT) AS id FROM nation""")
def yaml_typing(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    text = F.concat(F.lit("id: "), "n_nationkey", F.lit("\nname: "), "n_name", F.lit("\nq: '"), "n_nationkey", F.lit("'\nf: "), "n_nationkey", F.lit(".5\nb: True\nz: ~\n"))
    n = n.withColumn("text", text)
    of = lambda p: TY.kind("text", p)
    return n.select("n_nationkey", of("/id").alias("id_kind"), of("/name").alias("name_kind"), of("/q").alias("quoted_kind"), of("/f").alias("float_kind"), of("/b").alias("bool_kind"), of("/z").alias("null_kind"), TY.as_int("text", "/id").alias("id"))


@query("SELECT p_partkey, 'int' AS key_kind, 'string' AS name_kind, CASE WHEN p_retailprice = floor(p_retailprice) THEN 'float' ELSE 'float' END AS price_kind FROM part")
def yaml_plain_kind(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    price = F.concat(F.floor("p_retailprice").cast("string"), F.lit(".25"))
    return p.select("p_partkey", TY.plain_kind(F.col("p_partkey").cast("string")).alias("key_kind"), TY.plain_kind(F.col("p_name")).alias("name_kind"), TY.plain_kind(price).alias("price_kind"))


@query("""SELECT n_nationkey, '{"b":2,"d":5,"k":' || n_nationkey || '}' AS merged, true AS has_merge, '{"k":' || n_nationkey || '}' AS aliased FROM nation""")
def yaml_merge_alias(spark, sf_dir):
    text = F.concat(F.lit("base: &b {b: 1}\nmore: &m {b: 2}\nconfig: {<<: [*b, *m], d: 5, k: "), "n_nationkey", F.lit("}\nref: &r {k: "), "n_nationkey", F.lit("}\nagain: *r\n"))
    options = YamlToJsonOptions(allow_resolved_aliases=True, allow_merge_keys=True)
    n = _table(spark, sf_dir, "nation").withColumn("text", text).withColumn("json", TY.to_json(F.col("text"), YamlParseOptions(), options))
    return n.select("n_nationkey", TJ.pointer_get("json", "/config").alias("merged"), TY.has_merge_keys("text").alias("has_merge"), TJ.pointer_get("json", "/again").alias("aliased"))


@query("SELECT n_nationkey, 2 AS documents, n_name AS name, 'E_DUPKEY' AS duplicate, CAST(n_regionkey AS VARCHAR) AS last FROM nation")
def yaml_documents(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").withColumn("text", F.concat(F.lit("---\na: 1\n---\nname: "), "n_name", F.lit("\n")))
    n = n.withColumn("twice", F.concat(F.lit("a: "), "n_nationkey", F.lit("\na: "), "n_regionkey"))
    last = TY.to_json("twice", YamlParseOptions(dupkeys="LAST_WINS"))
    return n.select("n_nationkey", TY.document_count("text").alias("documents"), F.get_json_object(TY.all_to_json("text")[1], "$.name").alias("name"), TY.to_json_result("twice")["error"]["code"].alias("duplicate"), F.get_json_object(last, "$.a").alias("last"))


@query("""SELECT n_nationkey, 0 AS doc_index, '' AS path, 'mapping' AS kind, CAST(NULL AS VARCHAR) AS value FROM nation
UNION ALL SELECT n_nationkey, 0, '/name', 'string', n_name FROM nation UNION ALL SELECT n_nationkey, 0, '/ids', 'sequence', NULL FROM nation
UNION ALL SELECT n_nationkey, 0, '/ids/0', 'int', CAST(n_nationkey AS VARCHAR) FROM nation""")
def yaml_nodes(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").withColumn("text", F.concat(F.lit("name: "), "n_name", F.lit("\nids:\n- "), "n_nationkey", F.lit("\n")))
    return n.lateralJoin(TY.yaml_nodes(F.col("text").outer())).where("role <> 'key'").select("n_nationkey", "doc_index", "path", "kind", "value")


@query("SELECT n_nationkey, 'id: ' || n_nationkey || chr(10) || 'name: ' || n_name || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - b' AS yaml FROM nation")
def yaml_write(spark, sf_dir):
    text = F.concat(F.lit("id:   "), "n_nationkey", F.lit("   # c\nname: "), "n_name", F.lit("\ntags:\n- a\n- b\n"))
    found = TY.edit("text", _no_comments)
    return _table(spark, sf_dir, "nation").withColumn("text", text).select("n_nationkey", found["value"].alias("yaml"))


def _no_comments(doc) -> None:
    for _, v in doc.root.value:
        v.inline_comment = None


@query("""SELECT n_nationkey, 'a: ' || n_nationkey || chr(10) || 'b: 2' AS put, '- 0' || chr(10) || '- ' || n_nationkey AS inserted, 'b: 1' AS dropped FROM nation""")
def yaml_edits(spark, sf_dir):
    n = _table(spark, sf_dir, "nation").withColumn("a", F.concat(F.lit("a: "), "n_nationkey")).withColumn("s", F.concat(F.lit("- "), "n_nationkey"))
    return n.select("n_nationkey", TY.mapping_set("a", "", "b", F.lit("2"))["value"].alias("put"), TY.sequence_insert("s", "", 0, F.lit("0"))["value"].alias("inserted"), TY.mapping_delete(F.concat("a", F.lit("\nb: 1")), "", "a")["value"].alias("dropped"))


@query(f"""SELECT CAST(event_id AS VARCHAR) AS doc_id, true AS ok, '{{"k":' || {K} || '}}' AS value, CAST(NULL AS VARCHAR) AS code FROM events""")
def json_chunks(spark, sf_dir):
    from ..streaming.chunks import parse_chunks_batch

    e = _events(spark, sf_dir)
    parts = F.array(*[F.struct(F.lit(i).alias("chunk_no"), F.substring("props", 1 + 3 * i, 3 if i < 2 else 1000).alias("text"), F.lit(i == 2).alias("is_last")) for i in range(3)])
    return parse_chunks_batch(e.select(F.col("event_id").alias("doc_id"), F.explode(parts).alias("c")).select("doc_id", "c.*"))


@query("SELECT '0.1.0' AS version, 0 AS major, 1 AS minor, 0 AS patch")
def version(spark, sf_dir):
    from .. import __version__

    major, minor, patch = map(int, __version__.split("."))
    return spark.range(1).select(F.lit(__version__).alias("version"), F.lit(major).alias("major"), F.lit(minor).alias("minor"), F.lit(patch).alias("patch"))
