"""Strict JSON on plain Python values: parse, write, point, patch, merge, compare, validate.

null, booleans and strings are Python's own; arrays are lists; objects are
dicts in insertion order; numbers are ``Number``, which keeps the source text.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from ..core import JsonParseOptions, JsonWriteOptions, TextError

NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
PLAIN_SINGLE = re.compile(r"[^'\\\x00-\x1f]*")
SPACE = re.compile(r"[ \t\r\n]*")
INTEGER = re.compile(r"-?[0-9]+\Z")
SURROGATE = re.compile(r"[\ud800-\udfff]")
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class Number:
    """A number as its text, with the representations that hold it."""

    __slots__ = ("lexeme",)

    def __init__(self, lexeme: str):
        self.lexeme = lexeme

    @property
    def i64(self) -> int | None:
        if INTEGER.match(self.lexeme) and -(1 << 63) <= (v := int(self.lexeme)) < 1 << 63:
            return v
        return None

    @property
    def u64(self) -> int | None:
        if self.lexeme[:1] != "-" and INTEGER.match(self.lexeme) and (v := int(self.lexeme)) < 1 << 64:
            return v
        return None

    @property
    def double(self) -> float | None:
        if self.lexeme in ("NaN", "Infinity", "-Infinity"):
            return float(self.lexeme.replace("Infinity", "inf"))
        v = float(self.lexeme)
        if math.isinf(v) or (abs(v) < 2.2250738585072014e-308 and re.search(r"[1-9]", re.split("[eE]", self.lexeme)[0])):
            return None  # overflow and underflow have no double
        return v

    def __eq__(self, other):
        return isinstance(other, Number) and self.lexeme == other.lexeme

    def __hash__(self):
        return hash(self.lexeme)

    def __repr__(self):
        return f"Number({self.lexeme!r})"


def kind_of(v) -> str:
    if v is None:
        return "null"
    return {bool: "bool", str: "string", list: "array", dict: "object", Number: "number"}[type(v)]


class _Parser:
    def __init__(self, text: str, o: JsonParseOptions):
        self.t, self.o, self.p = text, o, 0

    def fail(self, code: str, message: str, at: int | None = None):
        raise TextError.at(code, message, self.t, self.p if at is None else at)

    def space(self) -> None:
        while True:
            self.p = SPACE.match(self.t, self.p).end()
            if not self.o.allow_comments or not self.t.startswith(("//", "/*"), self.p):
                return
            if self.t[self.p + 1] == "/":
                end = self.t.find("\n", self.p)
                self.p = len(self.t) if end < 0 else end + 1
            else:
                end = self.t.find("*/", self.p + 2)
                if end < 0:
                    self.fail("E_INCOMPLETE", "comment is not closed")
                self.p = end + 2

    def value(self, depth: int):
        self.space()
        t, p = self.t, self.p
        if p >= len(t):
            self.fail("E_INCOMPLETE", "a value is missing at the end of input")
        c = t[p]
        if c in "[{":
            if depth >= self.o.max_depth:
                self.fail("E_DEPTH", "nesting is too deep")
            return self.array(depth + 1) if c == "[" else self.object(depth + 1)
        if c == '"' or c == "'" and self.o.allow_single_quotes:
            return self.string()
        for word, v in (("true", True), ("false", False), ("null", None)):
            if t.startswith(word, p):
                self.p += len(word)
                self.word_end()
                return v
        for word in ("NaN", "Infinity", "-Infinity"):
            if t.startswith(word, p):
                if not self.o.allow_nonfinite_numbers:
                    self.fail("E_NONFINITE", f"{word} is not allowed")
                self.p += len(word)
                self.word_end()
                return Number(word)
        if c in "-.+0123456789":
            m = NUMBER.match(t, p)
            if not m or t[m.end() : m.end() + 1] and t[m.end()] in "0123456789.eE+-":
                self.fail("E_BAD_NUMBER", "not a number")
            self.p = m.end()
            self.word_end()
            return Number(m[0])
        return self.fail("E_BAD_TOKEN", f"unexpected character {c!r}")

    def word_end(self) -> None:
        c = self.t[self.p : self.p + 1]
        if c and (c.isalnum() or c in "_$"):
            self.fail("E_BAD_TOKEN", "unexpected character after a value")

    def string(self) -> str:
        t, start = self.t, self.p
        q = t[start]
        plain, out, p = PLAIN if q == '"' else PLAIN_SINGLE, [], start + 1
        while True:
            m = plain.match(t, p)
            out.append(m[0])
            p = m.end()
            if p >= len(t):
                self.fail("E_INCOMPLETE", "string is not closed", start)
            c = t[p]
            if c == q:
                break
            if c == "\\":
                e = t[p + 1 : p + 2]
                if e == "u":
                    v, p = self.unicode(p)
                    out.append(v)
                    continue
                if e == "'" and self.o.allow_single_quotes:
                    out.append("'")
                elif e in ESCAPES and e:
                    out.append(ESCAPES[e])
                else:
                    self.fail("E_BAD_ESCAPE" if e else "E_INCOMPLETE", "unknown escape", p)
                p += 2
            elif self.o.allow_unescaped_controls:
                out.append(c)
                p += 1
            else:
                self.fail("E_BAD_TOKEN", "control character in a string", p)
        self.p = p + 1
        s = "".join(out)
        if self.o.validate_utf8 and SURROGATE.search(s):
            self.fail("E_BAD_UNICODE", "lone surrogate", start)
        if len(s) * 4 > self.o.max_string_bytes and len(s.encode("utf-8", "surrogatepass")) > self.o.max_string_bytes:
            self.fail("E_LIMIT", "string is too long", start)
        return s

    def unicode(self, p: int) -> tuple[str, int]:
        def code(at: int) -> int:
            h = self.t[at + 2 : at + 6]
            if not re.fullmatch(r"[0-9a-fA-F]{4}", h):
                self.fail("E_BAD_UNICODE", "four hexadecimal digits are needed", at)
            return int(h, 16)

        v = code(p)
        if 0xD800 <= v < 0xDC00:
            if not self.t.startswith("\\u", p + 6) or not 0xDC00 <= (low := code(p + 6)) < 0xE000:
                self.fail("E_BAD_UNICODE", "high surrogate without a low one", p)
            return chr(0x10000 + ((v - 0xD800) << 10) + low - 0xDC00), p + 12
        if 0xDC00 <= v < 0xE000:
            self.fail("E_BAD_UNICODE", "low surrogate without a high one", p)
        return chr(v), p + 6

    def array(self, depth: int) -> list:
        out, self.p = [], self.p + 1
        self.space()
        if self.t[self.p : self.p + 1] == "]":
            self.p += 1
            return out
        while True:
            out.append(self.value(depth))
            if len(out) > self.o.max_container_elems:
                self.fail("E_LIMIT", "array has too many elements")
            if self.more("]"):
                return out

    def more(self, close: str) -> bool:
        """Reads a comma or the closing bracket; true at the end of the container."""
        self.space()
        c = self.t[self.p : self.p + 1]
        if not c:
            self.fail("E_INCOMPLETE", f"{close} is missing")
        if c not in (",", close):
            self.fail("E_BAD_TOKEN", f"a comma or {close} is needed")
        self.p += 1
        if c == close:
            return True
        self.space()
        if self.t[self.p : self.p + 1] == close:
            if not self.o.allow_trailing_commas:
                self.fail("E_BAD_TOKEN", "trailing comma")
            self.p += 1
            return True
        return False

    def object(self, depth: int) -> dict:
        out: dict = {}
        count, self.p = 0, self.p + 1
        self.space()
        if self.t[self.p : self.p + 1] == "}":
            self.p += 1
            return out
        while True:
            self.space()
            at = self.p
            c = self.t[at : at + 1]
            if not c:
                self.fail("E_INCOMPLETE", "a key is missing")
            if c != '"' and not (c == "'" and self.o.allow_single_quotes):
                self.fail("E_BAD_TOKEN", "a key must be a string")
            key = self.string()
            self.space()
            if self.t[self.p : self.p + 1] != ":":
                self.fail("E_BAD_TOKEN" if self.p < len(self.t) else "E_INCOMPLETE", "a colon is needed")
            self.p += 1
            put(out, key, self.value(depth), self.o.dupkeys, lambda at=at, key=key: self.fail("E_DUPKEY", f"key {key!r} twice", at))
            count += 1
            if count > self.o.max_container_elems:
                self.fail("E_LIMIT", "object has too many members")
            if self.more("}"):
                return out


def put(out: dict, key: str, value, policy: str, error) -> None:
    """Adds a member under a duplicate policy. LAST_WINS keeps the first place; COLLECT extends an array that is there."""
    if key not in out:
        out[key] = value
    elif policy == "ERROR":
        error()
    elif policy == "LAST_WINS":
        out[key] = value
    elif policy == "COLLECT":
        out[key] = [*out[key], value] if isinstance(out[key], list) else [out[key], value]


class _Slow(Exception):
    pass


def _no(_):
    raise _Slow


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Slow
    return out


_fast = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_no, object_pairs_hook=_unique)


def parse(text: str, o: JsonParseOptions = JsonParseOptions()):
    """One value; anything but white space after it is an error."""
    body = _start(text, o)
    if body.count("[") + body.count("{") <= o.max_depth and len(body) <= min(o.max_string_bytes // 4, o.max_container_elems):
        try:
            v = _fast.decode(body)
            if "\\u" not in body and not SURROGATE.search(body) or not _has_surrogate(v):
                return v
        except (ValueError, RecursionError, _Slow):
            pass
    p = _Parser(body, o)
    v = p.value(0)
    p.space()
    if p.p < len(body):
        p.fail("E_TRAILING_GARBAGE", "input goes on after the value")
    return v


def _has_surrogate(v) -> bool:
    if isinstance(v, str):
        return SURROGATE.search(v) is not None
    if isinstance(v, list):
        return any(map(_has_surrogate, v))
    return isinstance(v, dict) and any(_has_surrogate(k) or _has_surrogate(x) for k, x in v.items())


def _start(text: str, o: JsonParseOptions) -> str:
    if len(text) * 4 > o.max_total_bytes and len(text.encode("utf-8", "surrogatepass")) > o.max_total_bytes:
        raise TextError("E_LIMIT", "input is too long", 0, 1, 1)
    if text[:1] == "﻿":
        if not o.allow_leading_bom:
            raise TextError.at("E_BAD_TOKEN", "byte order mark", text, 0)
        return text[1:]
    return text


def parse_many(text: str, o: JsonParseOptions = JsonParseOptions()):
    """Yields (start, end, value) of concatenated values, in code points."""
    shift = int(text[:1] == "﻿")
    p = _Parser(_start(text, o), o)
    p.space()
    while p.p < len(p.t):
        start = p.p
        v = p.value(0)
        yield start + shift, p.p + shift, v
        p.space()


def events(text: str, o: JsonParseOptions = JsonParseOptions()):
    """Yields (type, text) in document order. Duplicate keys are passed on as they come."""
    p = _Parser(_start(text, o), o)

    def walk(depth: int):
        p.space()
        c = p.t[p.p : p.p + 1]
        if c not in ("[", "{") or not c:
            v = p.value(depth)
            yield {"null": "NULL", "bool": "BOOL", "string": "STRING", "number": "NUMBER"}[kind_of(v)], None if v is None else v.lexeme if isinstance(v, Number) else str(v).lower() if isinstance(v, bool) else v
            return
        if depth >= o.max_depth:
            p.fail("E_DEPTH", "nesting is too deep")
        close, name = ("]", "ARRAY") if c == "[" else ("}", "OBJECT")
        yield f"{name}_BEGIN", None
        p.p += 1
        p.space()
        if p.t[p.p : p.p + 1] == close:
            p.p += 1
        else:
            while True:
                if close == "}":
                    p.space()
                    if p.t[p.p : p.p + 1] not in ('"', "'" if o.allow_single_quotes else '"'):
                        p.fail("E_BAD_TOKEN" if p.p < len(p.t) else "E_INCOMPLETE", "a key must be a string")
                    yield "KEY", p.string()
                    p.space()
                    if p.t[p.p : p.p + 1] != ":":
                        p.fail("E_BAD_TOKEN" if p.p < len(p.t) else "E_INCOMPLETE", "a colon is needed")
                    p.p += 1
                yield from walk(depth + 1)
                if p.more(close):
                    break
        yield f"{name}_END", None

    yield from walk(0)
    p.space()
    if p.p < len(p.t):
        p.fail("E_TRAILING_GARBAGE", "input goes on after the value")


SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
NEEDS = re.compile(r'["\\\x00-\x1f]')


def units(c: str) -> list[int]:
    """UTF-16 code units of a character."""
    v = ord(c)
    return [v] if v < 0x10000 else [0xD800 + (v - 0x10000 >> 10), 0xDC00 + (v & 0x3FF)]


def quote(s: str, o: JsonWriteOptions = JsonWriteOptions()) -> str:
    s = NEEDS.sub(lambda m: SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", s)
    if o.escape_solidus:
        s = s.replace("/", "\\/")
    if o.escape_unicode or o.escape_all_non_ascii:
        s = re.sub(r"[^\x00-\x7f]", lambda m: "".join(f"\\u{u:04X}" for u in units(m[0])), s)
    return f'"{s}"'


def number_text(n: Number, o: JsonWriteOptions) -> str:
    if n.lexeme in ("NaN", "Infinity", "-Infinity"):
        if not o.allow_nonfinite_numbers:
            raise TextError("E_NONFINITE", f"{n.lexeme} is not allowed")
        return n.lexeme
    if not o.canonical_numbers:
        return n.lexeme
    for v in (n.i64, n.u64):
        if v is not None:
            return str(v)
    return n.lexeme if n.double is None else double_text(n.double, o)


def double_text(v: float, o: JsonWriteOptions = JsonWriteOptions()) -> str:
    precision = max(0, min(20, o.float_precision))
    return f"{v:.17g}" if o.float_format == "SHORTEST" else f"{v:.{precision}f}" if o.float_format == "FIXED" else f"{v:.{precision}e}"


def write(v, o: JsonWriteOptions = JsonWriteOptions()) -> str:
    out: list[str] = []
    colon = ": " if o.pretty or o.space_after_colon else ":"

    def inline(size: int, threshold: int) -> bool:
        return not o.pretty or size == 0 or threshold >= 0 and size <= threshold

    def walk(v, depth: int) -> None:
        if v is None:
            out.append("null")
        elif v is True or v is False:
            out.append("true" if v else "false")
        elif isinstance(v, Number):
            out.append(number_text(v, o))
        elif isinstance(v, str):
            out.append(quote(v, o))
        else:
            array = isinstance(v, list)
            flat = inline(len(v), o.inline_array_threshold if array else o.inline_object_threshold)
            step = "" if flat else o.newline + " " * (o.indent_spaces * (depth + 1))
            comma = "," + (step if not flat else " " if o.space_after_comma or o.pretty else "")
            items = list(v) if array else list(v.items())
            if o.sort_object_keys and not array:
                items.sort(key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
            out.append("[" if array else "{")
            for i, x in enumerate(items):
                out.append(comma if i else step)
                if not array:
                    out.append(quote(x[0], o) + colon)
                walk(x if array else x[1], depth + 1)
            if not flat:
                out.append(o.newline + " " * (o.indent_spaces * depth))
            out.append("]" if array else "}")

    walk(v, 0)
    return "".join(out) + (o.newline if o.trailing_newline else "")


class EventWriter:
    """Writes values from events; misplaced events are E_STATE."""

    def __init__(self, options: JsonWriteOptions = JsonWriteOptions()):
        self.o, self.stack, self.done, self.root = options, [], False, None

    def _add(self, v) -> None:
        if not self.stack:
            if self.done:
                raise TextError("E_STATE", "a second root value")
            self.root, self.done = v, True
            return
        box, key = self.stack[-1]
        if isinstance(box, list):
            box.append(v)
        elif key is None:
            raise TextError("E_STATE", "a value without a key")
        else:
            box[key] = v
            self.stack[-1][1] = None

    def event(self, kind: str, text: str | None = None) -> None:
        if kind in ("ARRAY_BEGIN", "OBJECT_BEGIN"):
            box = [] if kind[0] == "A" else {}
            self._add(box)
            self.stack.append([box, None])
        elif kind in ("ARRAY_END", "OBJECT_END"):
            if not self.stack or isinstance(self.stack[-1][0], list) != (kind[0] == "A") or self.stack[-1][1] is not None:
                raise TextError("E_STATE", f"{kind} is out of place")
            self.stack.pop()
        elif kind == "KEY":
            if not self.stack or isinstance(self.stack[-1][0], list) or self.stack[-1][1] is not None:
                raise TextError("E_STATE", "a key is out of place")
            self.stack[-1][1] = text
        else:
            self._add({"NULL": lambda: None, "BOOL": lambda: text == "true", "NUMBER": lambda: Number(text), "STRING": lambda: text}[kind]())

    def finish(self) -> str:
        if self.stack or not self.done:
            raise TextError("E_INCOMPLETE", "the document is not complete")
        return write(self.root, self.o)


def tokens_of(pointer: str) -> list[str]:
    """Reference tokens of an RFC 6901 pointer."""
    if pointer == "":
        return []
    if pointer[0] != "/":
        raise TextError("E_INVALID", "a pointer starts with /")
    if re.search(r"~(?![01])", pointer):
        raise TextError("E_INVALID", "~ must be ~0 or ~1")
    return [t.replace("~1", "/").replace("~0", "~") for t in pointer[1:].split("/")]


def index_of(token: str) -> int | None:
    return int(token) if re.fullmatch(r"0|[1-9][0-9]*", token) else None


MISSING = object()


def point(root, pointer: str | list[str], compat: str = "rfc"):
    """The value at a pointer or MISSING. compat='reference': empty tokens are skipped and numeric tokens index arrays only."""
    v = root
    for t in tokens_of(pointer) if isinstance(pointer, str) else pointer:
        i = index_of(t)
        if compat == "reference" and (t == "" or i is not None and not isinstance(v, list)):
            if t == "":
                continue
            return MISSING
        if isinstance(v, list):
            if i is None or i >= len(v):
                return MISSING
            v = v[i]
        elif isinstance(v, dict):
            v = v.get(t, MISSING)
            if v is MISSING:
                return MISSING
        else:
            return MISSING
    return v


def clone(v):
    if isinstance(v, list):
        return [clone(x) for x in v]
    if isinstance(v, dict):
        return {k: clone(x) for k, x in v.items()}
    return v


def equal(a, b, mode: str = "NUMERIC") -> bool:
    """Deep equality; member order does not matter. LEXEME compares number texts, NUMERIC values."""
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, Number):
        if mode == "LEXEME":
            return a.lexeme == b.lexeme
        for x, y in ((a.i64, b.i64), (a.u64, b.u64)):
            if x is not None and y is not None:
                return x == y
        x, y = a.double, b.double
        return a.lexeme == b.lexeme if x is None or y is None else x == y or abs(x - y) < 1e-15
    if isinstance(a, list):
        return len(a) == len(b) and all(equal(x, y, mode) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return len(a) == len(b) and all(k in b and equal(x, b[k], mode) for k, x in a.items())
    return a == b


def _parent(root, tokens: list[str]):
    v = point(root, tokens[:-1])
    if v is MISSING or not isinstance(v, (list, dict)):
        raise TextError("E_INVALID", "the path's parent is missing")
    return v, tokens[-1]


def _add(root, tokens: list[str], value):
    if not tokens:
        return value
    box, t = _parent(root, tokens)
    if isinstance(box, dict):
        box[t] = value
    else:
        i = len(box) if t == "-" else index_of(t)
        if i is None or i > len(box):
            raise TextError("E_INVALID", "array index is out of range")
        box.insert(i, value)
    return root


def _remove(root, tokens: list[str]):
    if not tokens:
        raise TextError("E_INVALID", "the root cannot be removed")
    box, t = _parent(root, tokens)
    key = index_of(t) if isinstance(box, list) else t
    if key is None or (key >= len(box) if isinstance(box, list) else key not in box):
        raise TextError("E_INVALID", "the path is missing")
    return box.pop(key)


def patch(root, operations):
    """RFC 6902, all or nothing; ``root`` is not changed."""
    if not isinstance(operations, list):
        raise TextError("E_INVALID", "a patch is an array")
    root = clone(root)
    for op in operations:
        if not isinstance(op, dict) or not isinstance(op.get("op"), str) or not isinstance(op.get("path"), str):
            raise TextError("E_INVALID", "an operation needs op and path")
        name, path = op["op"], tokens_of(op["path"])
        if name in ("add", "replace", "test") and "value" not in op or name in ("move", "copy") and not isinstance(op.get("from"), str):
            raise TextError("E_INVALID", f"{name} lacks a member")
        if name == "add":
            root = _add(root, path, clone(op["value"]))
        elif name == "remove":
            _remove(root, path)
        elif name == "replace":
            if point(root, path) is MISSING:
                raise TextError("E_INVALID", "the path is missing")
            if not path:
                root = clone(op["value"])
            else:
                box, t = _parent(root, path)
                box[index_of(t) if isinstance(box, list) else t] = clone(op["value"])
        elif name in ("move", "copy"):
            source = tokens_of(op["from"])
            v = point(root, source)
            if v is MISSING:
                raise TextError("E_INVALID", "from is missing")
            if name == "move":
                if path[: len(source)] == source and len(path) > len(source):
                    raise TextError("E_INVALID", "a value cannot move into itself")
                if path == source:
                    continue
                v = _remove(root, source)
            else:
                v = clone(v)
            root = _add(root, path, v)
        elif name == "test":
            v = point(root, path)
            if v is MISSING or not equal(v, op["value"]):
                raise TextError("E_INVALID", "test failed")
        else:
            raise TextError("E_INVALID", f"unknown operation {name!r}")
    return root


def merge_patch(target, change):
    """RFC 7386."""
    if not isinstance(change, dict):
        return clone(change)
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in change.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge(target, source, policy: str = "LAST_WINS"):
    """Recursive merge of two objects: FIRST_WINS, LAST_WINS, or ERROR on any key of both."""
    if not isinstance(target, dict) or not isinstance(source, dict):
        raise TextError("E_INVALID", "both values must be objects")
    out = dict(target)
    for k, v in source.items():
        if k not in out:
            out[k] = v
        elif policy == "ERROR":
            raise TextError("E_DUPKEY", f"key {k!r} is in both")
        elif isinstance(out[k], dict) and isinstance(v, dict):
            out[k] = merge(out[k], v, policy)
        elif policy == "LAST_WINS":
            out[k] = v
    return out


TYPES = {"null": "null", "boolean": "bool", "number": "number", "string": "string", "array": "array", "object": "object"}


class Schema:
    """The compiled keywords type, properties, required, items, enum, const, minimum, maximum and the length limits; others are ignored."""

    def __init__(self, doc):
        if not isinstance(doc, dict):
            raise TextError("E_INVALID", "a schema is an object")
        get = doc.get
        names = get("type", [])
        names = [names] if isinstance(names, str) else names
        if not isinstance(names, list) or any(n not in TYPES for n in names if isinstance(n, str)) or any(not isinstance(n, str) for n in names):
            raise TextError("E_INVALID", "unknown type")
        self.types = {TYPES[n] for n in names}
        self.properties = {k: Schema(v) for k, v in self._of(get("properties", {}), dict).items()}
        self.required = self._of(get("required", []), list)
        self.items = Schema(doc["items"]) if "items" in doc else None
        self.enum = self._of(doc["enum"], list) if "enum" in doc else None
        self.const = doc.get("const", MISSING)
        self.limits = {k: self._number(doc[k]) for k in ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems") if k in doc}

    @staticmethod
    def _of(v, kind):
        if not isinstance(v, kind):
            raise TextError("E_INVALID", "a keyword has a wrong type")
        return v

    @staticmethod
    def _number(v) -> float:
        if not isinstance(v, Number) or v.double is None:
            raise TextError("E_INVALID", "a limit must be a number")
        return v.double

    def check(self, v) -> None:
        def fail(what: str):
            raise TextError("E_SCHEMA", what)

        if self.const is not MISSING:
            if not equal(v, self.const):
                fail("const")
            return
        if self.enum is not None and not any(equal(v, x) for x in self.enum):
            fail("enum")
        kind = kind_of(v)
        if self.types and kind not in self.types:
            fail("type")
        lim = self.limits
        if kind == "number" and v.double is not None:
            if "minimum" in lim and v.double < lim["minimum"]:
                fail("minimum")
            if "maximum" in lim and v.double > lim["maximum"]:
                fail("maximum")
        size = len(v.encode("utf-8", "surrogatepass")) if kind == "string" else len(v) if kind == "array" else 0
        for k, low in (("string", "Length"), ("array", "Items")):
            if kind == k:
                if size < lim.get(f"min{low}", 0):
                    fail(f"min{low}")
                if size > lim.get(f"max{low}", math.inf):
                    fail(f"max{low}")
        if kind == "array" and self.items:
            for x in v:
                self.items.check(x)
        if kind == "object":
            for k in self.required:
                if k not in v:
                    fail(f"required {k}")
            for k, s in self.properties.items():
                if k in v:
                    s.check(v[k])


@lru_cache(maxsize=64)
def compiled(schema: str) -> Schema:
    return Schema(parse(schema))


def nodes(v):
    """Yields the node table of a value: dicts of id, parent, depth, ordinal, key, path, kind and the scalar's forms."""
    count = 0

    def walk(v, parent, depth, ordinal, key, path):
        nonlocal count
        me, kind = count, kind_of(v)
        count += 1
        n = v if isinstance(v, Number) else None
        yield {
            "node_id": me, "parent_id": parent, "depth": depth, "ordinal": ordinal, "key": key, "path": path, "kind": kind,
            "lexeme": n.lexeme if n else None, "str": v if kind == "string" else None, "bool": v if kind == "bool" else None,
            "i64": n.i64 if n else None, "u64": n.u64 if n else None, "dbl": n.double if n else None,
        }
        if kind == "array":
            for i, x in enumerate(v):
                yield from walk(x, me, depth + 1, i, None, f"{path}/{i}")
        elif kind == "object":
            for i, (k, x) in enumerate(v.items()):
                yield from walk(x, me, depth + 1, i, k, f"{path}/{k.replace('~', '~0').replace('/', '~1')}")

    yield from walk(v, None, 0, 0, None, "")
