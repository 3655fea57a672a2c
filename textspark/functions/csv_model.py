"""Strict CSV on Python values: records of string fields, ragged rows kept."""

from __future__ import annotations

import re
from functools import lru_cache

from ..core import CsvParseOptions, CsvWriteOptions, TextError

ESCAPED = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"'}


@lru_cache(maxsize=64)
def _plain(delimiter: str, quote: str):
    return re.compile(rf"[^{re.escape(delimiter)}{re.escape(quote)}\r\n]*")


def records(text: str, o: CsvParseOptions = CsvParseOptions()):
    """Yields each record as a list of fields. Blank lines and comments are no records."""
    d, t, p, end = o.dialect, text, 0, len(text)
    if len(t) * 4 > o.max_total_bytes and len(t.encode("utf-8", "surrogatepass")) > o.max_total_bytes:
        raise TextError("E_LIMIT", "input is too long", 0, 1, 1)
    if not o.keep_bom and t[:1] == "﻿":
        p = 1
    plain, closing = _plain(d.delimiter, d.quote), re.compile(re.escape(d.quote) + (r"|\\" if d.escape == "BACKSLASH" else ""))
    row, rows, start = [], 0, p

    def fail(code: str, message: str, at: int):
        raise TextError.at(code, message, t, at, o.context_radius_bytes)

    def newline(at: int) -> int:
        """Length of the line break at a place, 0 if there is none; CRLF goes before LF before CR."""
        if t.startswith("\r\n", at) and d.accept_crlf:
            return 2
        c = t[at]
        if c == "\n":
            return 1 if d.accept_lf else fail("E_INVALID", "LF is no line break here", at)
        return 1 if d.accept_cr else fail("E_INCOMPLETE_CRLF" if d.accept_crlf else "E_INVALID", "CR without LF", at)

    def quoted(at: int) -> tuple[str, int]:
        out, q = [], at + 1
        while True:
            m = closing.search(t, q)
            if m is None:
                fail("E_UNTERMINATED_QUOTE", "quote is not closed", at)
            out.append(t[q : m.start()])
            if m[0] == "\\":
                c = t[m.end() : m.end() + 1]
                if c not in ESCAPED or not c:
                    fail("E_INVALID_ESCAPE", "unknown escape", m.start())
                out.append(ESCAPED[c])
                q = m.end() + 1
            elif d.escape == "DOUBLED_QUOTE" and t.startswith(d.quote, m.end()):
                out.append(d.quote)
                q = m.end() + 1
            else:
                s = "".join(out)
                if not d.newline_in_quotes and ("\n" in s or "\r" in s):
                    fail("E_INVALID", "line break in quotes", at)
                return s, m.end()

    while p < end:
        if not row and p == start:
            if t[p] in "\r\n":
                p += newline(p)
                start = p
                continue
            if d.allow_comments and t.startswith(d.comment_prefix, p):
                m = re.compile(r"[\r\n]").search(t, p)
                p = end if m is None else m.start() + newline(m.start())
                start = p
                continue
        if d.allow_space_after_delimiter and row:
            while t.startswith(" ", p):
                p += 1
        field_at = p
        if t.startswith(d.quote, p) and d.quote:
            field, p = quoted(p)
            if p < end and not t.startswith(d.delimiter, p) and t[p] not in "\r\n":
                fail("E_UNEXPECTED_QUOTE", "text after a closing quote", p)
        else:
            while True:
                p = plain.match(t, p).end()
                if p < end and not t.startswith(d.delimiter, p):
                    if t.startswith(d.quote, p):
                        if not d.allow_unquoted_quotes:
                            fail("E_UNEXPECTED_QUOTE", "quote in an unquoted field", p)
                        p += 1
                        continue
                    if d.allow_unquoted_newlines and t[p] in "\r\n" and not _ends(t, p, d):
                        p += 1
                        continue
                break
            field = t[field_at:p]
            if d.trim_unquoted_fields:
                field = field.strip(" \t")
        if len(field) * 4 > o.max_field_bytes and len(field.encode("utf-8", "surrogatepass")) > o.max_field_bytes:
            fail("E_FIELD_TOO_LARGE", "field is too long", field_at)
        row.append(field)
        if len(row) > o.max_cols:
            fail("E_TOO_MANY_COLS", "too many fields", field_at)
        if p < end and t.startswith(d.delimiter, p):
            p += len(d.delimiter)
            if p < end:
                continue
            row.append("")
        elif p < end:
            p += newline(p)
        if (p - start) * 4 > o.max_record_bytes and len(t[start:p].encode("utf-8", "surrogatepass")) > o.max_record_bytes:
            fail("E_RECORD_TOO_LARGE", "record is too long", start)
        rows += 1
        if rows > o.max_rows:
            fail("E_TOO_MANY_ROWS", "too many records", start)
        yield row
        row, start = [], p


def _ends(t: str, p: int, d) -> bool:
    """Whether an accepted line break is at p, for dialects with line breaks in unquoted fields."""
    return t.startswith("\r\n", p) and d.accept_crlf or t[p] == "\n" and d.accept_lf or t[p] == "\r" and d.accept_cr


def events(text: str, o: CsvParseOptions = CsvParseOptions()):
    """Yields (type, row, column, text): RECORD_BEGIN, FIELD, RECORD_END, END."""
    i = -1
    for i, row in enumerate(records(text, o)):
        yield "RECORD_BEGIN", i, None, None
        for j, f in enumerate(row):
            yield "FIELD", i, j, f
        yield "RECORD_END", i, None, None
    yield "END", i + 1, None, None


def field_text(field: str, o: CsvWriteOptions = CsvWriteOptions()) -> str:
    d = o.dialect
    needs = o.quote_all_fields or not field and o.quote_empty_fields or o.quote_if_needed and any(c in field for c in (d.delimiter, d.quote, "\r", "\n"))
    if not needs:
        return field
    if d.escape == "DOUBLED_QUOTE":
        field = field.replace(d.quote, d.quote * 2)
    elif d.escape == "BACKSLASH":
        field = field.replace("\\", "\\\\").replace(d.quote, "\\" + d.quote)
    return d.quote + field + d.quote


def write(rows, o: CsvWriteOptions = CsvWriteOptions()) -> str:
    out = []
    for row in rows:
        row = list(row)
        while o.trim_trailing_empty_fields and row and row[-1] == "":
            row.pop()
        out.append(o.dialect.delimiter.join(field_text(f, o) for f in row) + o.newline)
    return "".join(out) if out else o.newline if o.trailing_newline else ""


class RecordWriter:
    """Writes records field by field; misplaced calls are E_STATE. ``finish`` closes an open record."""

    def __init__(self, options: CsvWriteOptions = CsvWriteOptions()):
        self.o, self.out, self.row = options, [], None

    def record_begin(self) -> None:
        if self.row is not None:
            raise TextError("E_STATE", "a record is open")
        self.row = []

    def field(self, text: str) -> None:
        if self.row is None:
            raise TextError("E_STATE", "no record is open")
        self.row.append(text)

    def record_end(self) -> None:
        if self.row is None:
            raise TextError("E_STATE", "no record is open")
        self.out.append(self.row)
        self.row = None

    def finish(self) -> str:
        if self.row is not None:
            self.record_end()
        return write(self.out, self.o)


def header_map(header: list[str], mode: str = "FIRST_WINS") -> dict[str, list[int]]:
    """Indices of each name: one for FIRST_WINS and LAST_WINS, all for COLLECT; ERROR refuses duplicates."""
    out: dict[str, list[int]] = {}
    for i, name in enumerate(header):
        if name in out and mode == "ERROR":
            raise TextError("E_INVALID", f"header {name!r} twice")
        if name not in out or mode == "LAST_WINS":
            out[name] = [i]
        elif mode == "COLLECT":
            out[name].append(i)
    return out
