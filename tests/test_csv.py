"""Strict CSV: corpus, dialects, writer round trip, table edits."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textspark.core import CsvDialect, CsvParseOptions, CsvWriteOptions, TextError
from textspark.functions import csv_model as C
from textspark.operators.csv_table import CsvTable, line_text


def rows(text, **d):
    return list(C.records(text, CsvParseOptions(dialect=CsvDialect(**d))))


@pytest.mark.parametrize("text,expected,dialect", [
    ("name,age\nAlice,30\n", [["name", "age"], ["Alice", "30"]], {}),
    ('Alice,"She said ""Hello"""\n', [["Alice", 'She said "Hello"']], {}),
    ('Alice,"123 Main St\nNew York, NY"\n', [["Alice", "123 Main St\nNew York, NY"]], {}),
    ("a,b,c\n1,,3\n,5,\n", [["a", "b", "c"], ["1", "", "3"], ["", "5", ""]], {}),
    ("a\tb\n", [["a", "b"]], {"delimiter": "\t"}), ("a;b\n", [["a", "b"]], {"delimiter": ";"}),
    ('Alice,"She said \\"Hello\\""\n', [["Alice", 'She said "Hello"']], {"escape": "BACKSLASH"}),
    ("﻿name,age\n", [["name", "age"]], {}), ("a,b\r\nc,d\r\n", [["a", "b"], ["c", "d"]], {}), ("a,b\rc,d\r", [["a", "b"], ["c", "d"]], {"accept_cr": True}),
    ('"foo",,,,,"bar"\n"start",,,"middle",,"end"\n,,,"only_last"\n"only_first",,,\n', [["foo", "", "", "", "", "bar"], ["start", "", "", "middle", "", "end"], ["", "", "", "only_last"], ["only_first", "", "", ""]], {}),
    ("1,2,\n3,4,", [["1", "2", ""], ["3", "4", ""]], {}), ("value\ntest", [["value"], ["test"]], {}), ('a,"b"', [["a", "b"]], {}), ('"x ""h"", y",z\n', [['x "h", y', "z"]], {}),
    ("# c\na,b\n\n#d\nc,d\n", [["a", "b"], ["c", "d"]], {"allow_comments": True}), ('a"b,c\n', [['a"b', "c"]], {"allow_unquoted_quotes": True}), (" a , b \n", [["a", "b"]], {"trim_unquoted_fields": True}), ("", [], {}), ('""\n', [[""]], {}),
])
def test_corpus(text, expected, dialect):
    assert rows(text, **dialect) == expected


@pytest.mark.parametrize("text,code,dialect", [
    ('Alice,"30\nBob,25\n', "E_UNTERMINATED_QUOTE", {}), ('Alice"test,30\n', "E_UNEXPECTED_QUOTE", {}), ('"a"b,c\n', "E_UNEXPECTED_QUOTE", {}), ('"She \\x"\n', "E_INVALID_ESCAPE", {"escape": "BACKSLASH"}),
    ("Alice,30\rBob,25\n", "E_INCOMPLETE_CRLF", {}), ("a\nb\n", "E_INVALID", {"accept_lf": False}),
])
def test_invalid(text, code, dialect):
    with pytest.raises(TextError) as e:
        rows(text, **dialect)
    assert e.value.code == code


def test_limits():
    for o in (CsvParseOptions(max_rows=1), CsvParseOptions(max_cols=1), CsvParseOptions(max_field_bytes=1), CsvParseOptions(max_record_bytes=3), CsvParseOptions(max_total_bytes=5)):
        with pytest.raises(TextError):
            list(C.records("aa,bb\ncc,dd\n", o))


table = st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs"])), min_size=1, max_size=4), max_size=5)


@settings(max_examples=200, deadline=None)
@given(table, st.sampled_from(["DOUBLED_QUOTE", "BACKSLASH"]), st.booleans())
def test_write_then_parse(t, escape, quote_all):
    d = CsvDialect(escape=escape, delimiter=";")
    text = C.write(t, CsvWriteOptions(dialect=d, quote_all_fields=quote_all))
    got = list(C.records(text, CsvParseOptions(dialect=d, keep_bom=True)))
    assert got == t


def test_writer_states_and_events():
    w = C.RecordWriter()
    with pytest.raises(TextError):
        w.field("x")
    w.record_begin()
    w.field('a"b')
    with pytest.raises(TextError):
        w.record_begin()
    assert w.finish() == '"a""b"\n'
    assert [e[0] for e in C.events("a,b\n")] == ["RECORD_BEGIN", "FIELD", "FIELD", "RECORD_END", "END"]
    assert C.write([["a", "", ""]], CsvWriteOptions(trim_trailing_empty_fields=True)) == "a\n"
    assert C.header_map(["a", "b", "a"], "COLLECT") == {"a": [0, 2], "b": [1]} and C.header_map(["a", "a"], "LAST_WINS") == {"a": [1]}
    with pytest.raises(TextError):
        C.header_map(["a", "a"], "ERROR")


def cells(t):
    return [list(r.fields) for r in t.rows.orderBy("row_index").collect()]


def test_table_edits(spark):
    t = CsvTable.parse(spark, "a,b,a\n1,2,3\n4,5,6\n", CsvParseOptions(dialect=CsvDialect(treat_first_row_as_header=True)))
    assert (t.row_count(), t.col_count(0), t.field(1, 2), t.field(9, 9)) == (2, 3, "6", None)
    assert t.header_index("a") == 0 and t.header_index_next("a", 0) == 2 and not t.can_have_unique_headers()
    for bad in (lambda: t.header_index("z"), lambda: t.header_index_next("a", 2), lambda: t.row_append(["x"]), lambda: t.row_remove(5), lambda: t.column_rename(7, "x"), lambda: t.field_set(0, 9, "x"), lambda: t.column_append_with_values(None, ["only one"])):
        with pytest.raises(TextError):
            bad()
    u = t.row_insert(1, ["x", "y", "z"]).row_set(0, ["p", "q", "r"]).row_append(["7", "8", "9"])
    assert cells(u) == [["p", "q", "r"], ["x", "y", "z"], ["4", "5", "6"], ["7", "8", "9"]] and cells(t) == [["1", "2", "3"], ["4", "5", "6"]]
    v = t.column_append_with_values(None, ["h", "v0", "v1"]).column_insert(0, "first")
    assert v.header == ("first", "a", "b", "a", "h") and cells(v)[1] == ["", "4", "5", "6", "v1"]
    assert cells(t.column_remove(1)) == [["1", "3"], ["4", "6"]] and t.clear().row_count() == 0 and t.clear().header == t.header
    w = t.set_header_row(False)
    assert w.header is None and w.row_count() == 3 and w.set_header_row(True).header == ("a", "b", "a")
    t.validate()
    with pytest.raises(TextError):
        t.set_require_unique_headers(True).validate()


def test_ragged_rows(spark):
    t = CsvTable.from_rows(spark, [["1"], ["2", "3", "4"], ["5", "6"]], allow_irregular_rows=True)
    assert t.has_irregular_rows() and t.max_col_count() == 3 and t.min_col_count() == 1
    assert cells(t.normalize_to_max()) == [["1", "", ""], ["2", "3", "4"], ["5", "6", ""]]
    assert cells(t.normalize_rows(2, truncate_long_rows=True)) == [["1", ""], ["2", "3"], ["5", "6"]]
    assert cells(t.column_insert(2)) == [["1", "", ""], ["2", "3", "", "4"], ["5", "6", ""]]
    with pytest.raises(TextError):
        t.normalize_rows(2)


def test_files(spark, tmp_path):
    from textspark.sources import files

    (tmp_path / "a.csv").write_bytes('k,v\n1,"x\ny"\n2,\n'.encode())
    (tmp_path / "bad.csv").write_bytes(b'1,2\n"open')
    t = files.read_csv(spark, str(tmp_path / "a.csv"), CsvParseOptions(dialect=CsvDialect(treat_first_row_as_header=True)))
    assert t.header == ("k", "v") and cells(t) == [["1", "x\ny"], ["2", ""]]
    found = files.read_csv_files(spark, str(tmp_path / "bad.csv")).orderBy("row_index").collect()
    assert [(r.fields, r.code) for r in found if r.code is None] == [(["1", "2"], None)] and [r.code for r in found if r.code] == ["E_UNTERMINATED_QUOTE"]
    with pytest.raises(Exception, match="E_UNTERMINATED_QUOTE"):
        files.read_csv(spark, str(tmp_path / "bad.csv")).rows.collect()
    files.write_csv(t, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert list(C.records(text)) == [["k", "v"], ["1", "x\ny"], ["2", ""]]
    trusted = files.read_csv_trusted(spark, str(tmp_path / "plain.csv"), ["a", "b"]) if (tmp_path / "plain.csv").write_text("a,b\n1,\n") else None
    assert [tuple(r) for r in trusted.collect()] == [("1", "")]


def test_line_text_equals_model(spark):
    data = [["a", "", 'q"', "x,y", "l\n", "\\"]]
    df = spark.createDataFrame([(data[0],)], "fields array<string>")
    for o in (CsvWriteOptions(), CsvWriteOptions(quote_all_fields=True), CsvWriteOptions(dialect=CsvDialect(escape="BACKSLASH")), CsvWriteOptions(quote_empty_fields=False)):
        assert df.select(line_text(df.fields, o)).first()[0] + "\n" == C.write(data, o)
