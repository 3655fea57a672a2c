"""Tables of CSV rows as DataFrames (row_index, fields), with edits as DataFrame operations.

``CsvTable`` is immutable: every edit gives a new one. Row numbers count data
rows from 0; the header is kept on the driver. Nothing but the header, bounds
that an edit must check, and single cells is brought to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import CsvParseOptions, CsvWriteOptions, TextError
from ..functions import csv_model as C
from ..functions.json import strict

ROWS = "row_index bigint, fields array<string>"


def _invalid(message: str):
    raise TextError("E_INVALID", message)


@dataclass(frozen=True)
class CsvTable:
    rows: DataFrame
    header: tuple[str, ...] | None = None
    allow_irregular_rows: bool = False
    require_unique_headers: bool = False
    dup_mode: str = "FIRST_WINS"

    @classmethod
    def new(cls, spark: SparkSession, header=None, **flags) -> CsvTable:
        return cls(spark.createDataFrame([], ROWS), tuple(header) if header is not None else None, **flags)

    @classmethod
    def from_rows(cls, spark: SparkSession, rows, header=None, **flags) -> CsvTable:
        return cls(spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], ROWS), tuple(header) if header is not None else None, **flags)

    @classmethod
    def parse(cls, spark: SparkSession, text: str, options: CsvParseOptions = CsvParseOptions(), **flags) -> CsvTable:
        """A text on the driver; for files see ``sources.read_csv``."""
        rows, header = list(C.records(text, options)), None
        if options.dialect.treat_first_row_as_header:
            header = rows.pop(0) if rows else []
            C.header_map(header, options.dialect.header_dup_mode)
        return cls.from_rows(spark, rows, header, dup_mode=options.dialect.header_dup_mode, **flags)

    @classmethod
    def of(cls, df: DataFrame, order: list, **flags) -> CsvTable:
        """A rectangular DataFrame, numbered in the order of ``order`` without gathering it in one task."""
        fields = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
        return cls(numbered(df.select(fields.alias("fields"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]), [f"_o{i}" for i in range(len(order))]).select("row_index", "fields"), tuple(df.columns), **flags)

    # Accessors

    def row_count(self) -> int:
        return self.rows.count()

    def col_count(self, row: int) -> int:
        found = self.rows.where(F.col("row_index") == row).select(F.size("fields")).first()
        return found[0] if found else 0

    def field(self, row: int, col: int) -> str | None:
        found = self.rows.where(F.col("row_index") == row).select(F.get("fields", F.lit(col))).first()
        return found[0] if found else None

    def header_index(self, name: str) -> int:
        at = C.header_map(list(self.header or ()), self.dup_mode).get(name)
        return at[0] if at else _invalid(f"no header {name!r}")

    def header_index_next(self, name: str, after: int) -> int:
        found = next((i for i, h in enumerate(self.header or ()) if h == name and i > after), None)
        return _invalid(f"no further header {name!r}") if found is None else found

    def _widths(self):
        return self.rows.agg(F.min(F.size("fields")), F.max(F.size("fields")), F.count("*"), F.min_by(F.size("fields"), "row_index")).first()

    def max_col_count(self) -> int:
        return max(self._widths()[1] or 0, len(self.header or ()))

    def min_col_count(self) -> int:
        low = self._widths()[0]
        return min(x for x in (low, None if self.header is None else len(self.header)) if x is not None) if low is not None or self.header is not None else 0

    def column_count(self) -> int:
        return len(self.header) if self.header is not None else self._widths()[3] or 0

    def has_irregular_rows(self) -> bool:
        low, high, _, first = self._widths()
        n = len(self.header) if self.header is not None else first
        return low is not None and (low != n or high != n)

    def can_have_unique_headers(self) -> bool:
        return self.header is not None and len(set(self.header)) == len(self.header)

    def validate(self) -> None:
        bad = self.rows.agg(F.count_if(F.col("fields").isNull() | F.exists("fields", lambda x: x.isNull())), F.count("*"), F.max("row_index"), F.countDistinct("row_index")).first()
        if bad[0] or bad[1] and (bad[2] != bad[1] - 1 or bad[3] != bad[1]):
            _invalid("the table is not consistent")
        if self.require_unique_headers and not self.can_have_unique_headers():
            _invalid("headers repeat")
        if not self.allow_irregular_rows and self.has_irregular_rows():
            _invalid("rows differ in width")

    # Rows

    def _with(self, rows: DataFrame, **changes) -> CsvTable:
        return replace(self, rows=rows.select("row_index", "fields"), **changes)

    def _one(self, at: Column, fields) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.range(1).select(at.cast("long").alias("row_index"), F.array(*map(F.lit, fields)).cast("array<string>").alias("fields"))

    def _width_ok(self, fields) -> None:
        n = self.column_count()
        if not self.allow_irregular_rows and n and len(fields) != n:
            _invalid(f"a row must have {n} fields")

    def _in_range(self, row: int, extra: int = 0) -> None:
        if not 0 <= row < self.row_count() + extra:
            _invalid("row index is out of range")

    def row_append(self, fields) -> CsvTable:
        self._width_ok(fields)
        return self._with(self.rows.unionByName(self._one(F.lit(self.row_count()), fields)))

    def row_insert(self, row: int, fields) -> CsvTable:
        self._in_range(row, 1)
        self._width_ok(fields)
        shifted = self.rows.withColumn("row_index", F.when(F.col("row_index") >= row, F.col("row_index") + 1).otherwise(F.col("row_index")))
        return self._with(shifted.unionByName(self._one(F.lit(row), fields)))

    def row_remove(self, row: int) -> CsvTable:
        self._in_range(row)
        return self._with(self.rows.where(F.col("row_index") != row).withColumn("row_index", F.when(F.col("row_index") > row, F.col("row_index") - 1).otherwise(F.col("row_index"))))

    def row_set(self, row: int, fields) -> CsvTable:
        self._in_range(row)
        self._width_ok(fields)
        return self._with(self.rows.withColumn("fields", F.when(F.col("row_index") == row, F.array(*map(F.lit, fields)).cast("array<string>")).otherwise(F.col("fields"))))

    def field_set(self, row: int, col: int, value: str) -> CsvTable:
        if not 0 <= col < self.col_count(row):
            _invalid("cell is out of range")
        return self._with(self.rows.withColumn("fields", F.when(F.col("row_index") == row, F.transform("fields", lambda x, i: F.when(i == col, F.lit(value)).otherwise(x))).otherwise(F.col("fields"))))

    def clear(self) -> CsvTable:
        return self._with(self.rows.limit(0))

    def compact(self) -> CsvTable:
        """The same rows; the plan is cut by a checkpoint where the session has a folder for them."""
        has = self.rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        return self._with(self.rows.checkpoint() if has else self.rows)

    def clone(self) -> CsvTable:
        return self

    # Columns

    def _header_with(self, header: list[str]) -> tuple[str, ...]:
        if self.require_unique_headers and len(set(header)) != len(header):
            _invalid("headers repeat")
        return tuple(header)

    def column_append(self, name: str | None = None) -> CsvTable:
        return self.column_insert(self.column_count(), name)

    def column_insert(self, col: int, name: str | None = None) -> CsvTable:
        """An empty column; in a table of ragged rows shorter rows are padded up to it."""
        if not 0 <= col <= self.max_col_count():
            _invalid("column index is out of range")
        if self.header is not None and name is None:
            _invalid("a header needs a name")
        wide = _padded(F.col("fields"), col)
        header = None if self.header is None else self._header_with([*self.header[:col], *[""] * max(0, col - len(self.header)), name, *self.header[col:]])
        return self._with(self.rows.withColumn("fields", _put(wide, col, F.lit(""))), header=header)

    def column_insert_with_values(self, col: int, name: str | None, values) -> CsvTable:
        """One value for each row, the header's cell first where there is a header; ``values`` is a list or rows (row_index, value)."""
        if not 0 <= col <= self.max_col_count():
            _invalid("column index is out of range")
        if not isinstance(values, DataFrame):
            values, n = list(values), self.row_count()
            if not n + (self.header is not None) or len(values) != n + (self.header is not None):
                _invalid("there must be one value for each row")
            if self.header is not None:
                name, values = values[0] if name is None else name, values[1:]
            values = self.rows.sparkSession.createDataFrame(list(enumerate(values)), "row_index bigint, value string")
        header = None if self.header is None else self._header_with([*self.header[:col], name, *self.header[col:]])
        joined = self.rows.join(values, "row_index", "left")
        return self._with(joined.withColumn("fields", _put(_padded(F.col("fields"), col), col, F.coalesce("value", F.lit("")))), header=header)

    def column_append_with_values(self, name: str | None, values) -> CsvTable:
        return self.column_insert_with_values(self.column_count(), name, values)

    def column_remove(self, col: int) -> CsvTable:
        if not 0 <= col < self.max_col_count():
            _invalid("column index is out of range")
        header = None if self.header is None else tuple(h for i, h in enumerate(self.header) if i != col)
        return self._with(self.rows.withColumn("fields", F.filter("fields", lambda _, i: i != col)), header=header)

    def column_rename(self, col: int, name: str) -> CsvTable:
        if self.header is None or not 0 <= col < len(self.header):
            _invalid("no such header")
        return replace(self, header=self._header_with([name if i == col else h for i, h in enumerate(self.header)]))

    def set_require_unique_headers(self, on: bool) -> CsvTable:
        return replace(self, require_unique_headers=on)

    def set_allow_irregular_rows(self, on: bool) -> CsvTable:
        return replace(self, allow_irregular_rows=on)

    def normalize_rows(self, target: int | str = "max", truncate_long_rows: bool = False) -> CsvTable:
        """All rows and the header padded, or cut, to a width; "max" and "min" are those of the table."""
        n = self.max_col_count() if target in ("max", 0) else self.min_col_count() if target == "min" else target
        if not truncate_long_rows and self.max_col_count() > n:
            _invalid("a row is longer than the target")
        header = None if self.header is None else tuple([*self.header, *[""] * n][:n])
        return self._with(self.rows.withColumn("fields", F.slice(_padded(F.col("fields"), n), 1, n)), header=header)

    def normalize_to_max(self) -> CsvTable:
        return self.normalize_rows("max")

    def set_header_row(self, on: bool) -> CsvTable:
        """Makes row 0 the header, or the header row 0."""
        if on == (self.header is not None):
            return self if not on else _invalid("there is a header")
        if on:
            first = self.rows.where("row_index = 0").first()
            header = self._header_with(list(first.fields)) if first else _invalid("the table is empty")
            return self._with(self.rows.where("row_index > 0").withColumn("row_index", F.col("row_index") - 1), header=header)
        rows = self.rows.withColumn("row_index", F.col("row_index") + 1).unionByName(self._one(F.lit(0), self.header))
        return self._with(rows, header=None)

    # Output

    def to_columns(self) -> DataFrame:
        """A rectangular view: one string column for each header."""
        names = self.header or [f"c{i}" for i in range(self.max_col_count())]
        return self.rows.select("row_index", *[F.get("fields", F.lit(i)).alias(h) for i, h in enumerate(names)])

    def lines(self, options: CsvWriteOptions = CsvWriteOptions()) -> DataFrame:
        """(row_index, line) of the rows, quoted in the JVM; the header is row -1."""
        out = self.rows.select("row_index", line_text(F.col("fields"), options).alias("line"))
        if self.header is None:
            return out
        head = self.rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("row_index"), F.lit(C.write([self.header], options).removesuffix(options.newline)).alias("line"))
        return head.unionByName(out)


def _padded(fields: Column, n: int) -> Column:
    return F.concat(fields, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(n) - F.size(fields))))


def _put(fields: Column, col: int, value: Column) -> Column:
    return F.concat(F.slice(fields, 1, col), F.array(value), F.slice(fields, F.lit(col + 1), F.size(fields))) if col else F.concat(F.array(value), fields)


def field_column(field: Column, o: CsvWriteOptions = CsvWriteOptions()) -> Column:
    """A field quoted as the policy asks, in the JVM."""
    d = o.dialect
    body = field
    if d.escape == "DOUBLED_QUOTE":
        body = F.replace(body, F.lit(d.quote), F.lit(d.quote * 2))
    elif d.escape == "BACKSLASH":
        body = F.replace(F.replace(body, F.lit("\\"), F.lit("\\\\")), F.lit(d.quote), F.lit("\\" + d.quote))
    shown = F.concat(F.lit(d.quote), body, F.lit(d.quote))
    if o.quote_all_fields:
        return shown
    needs = F.lit(False)
    if o.quote_empty_fields:
        needs = needs | (field == "")
    if o.quote_if_needed:
        for c in (d.delimiter, d.quote, "\r", "\n"):
            needs = needs | F.contains(field, F.lit(c))
    return F.when(needs, shown).otherwise(field)


def line_text(fields: Column, o: CsvWriteOptions = CsvWriteOptions()) -> Column:
    if o.trim_trailing_empty_fields:
        last = F.array_max(F.transform(fields, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))))
        fields = F.slice(fields, F.lit(1), F.coalesce(last, F.lit(0)))
    return F.array_join(F.transform(fields, lambda x: field_column(x, o)), o.dialect.delimiter)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with row_index from 0 in an order: sorted by range, counted by partition, numbered within each.

    The sorted rows are read twice and must be the same both times, so they
    are checkpointed where the session has a folder for it and persisted where
    it has none.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    spread = spread.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else spread.persist()
    before = spread.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("row_index", inside.cast("long") - 1).join(F.broadcast(before), "_part").withColumn("row_index", F.col("row_index") + F.col("_before")).drop("_part", "_before")


def parse_column(text, options: CsvParseOptions = CsvParseOptions()) -> Column:
    """struct<ok, value: array<array<string>>, error> of a column of CSV texts."""
    return strict("array<array<string>>", lambda t: list(C.records(t, options)), text)


@F.udtf(returnType="seq: int, type: string, row: bigint, col: bigint, text: string, code: string")
class csv_events:
    def eval(self, text: str):
        if text is None:
            return
        seq = 0
        try:
            for kind, row, col, value in C.events(text):
                yield seq, kind, row, col, value, None
                seq += 1
        except TextError as e:
            yield seq, None, None, None, None, e.code
