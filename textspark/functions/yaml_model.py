"""YAML 1.2 on Python values: nodes, events, resolution, edits, JSON conversion and writing.

A parser by descent on columns builds ``Node`` trees; ``resolve`` gives types,
binds aliases, expands merge keys and applies duplicate-key policies. Clip
chomping of block scalars drops the last line break, as ``-`` does.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from typing import Any, Iterator

from ..core import JsonParseOptions, TextError, YamlParseOptions, YamlToJsonOptions, YamlWriteOptions
from . import json_model as J

ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
TAG_PREFIX = "tag:yaml.org,2002:"
STANDARD = {"null", "bool", "int", "float", "str", "seq", "map", "set", "omap", "pairs", "timestamp", "binary", "merge"}

NAME = re.compile(r"[^\s,\[\]{}]+")
STAMP = re.compile(r"(\d{4})-(\d\d?)-(\d\d?)(?:(?:[Tt]|[ \t]+)(\d\d?):(\d\d):(\d\d)(?:\.(\d{1,9}))?[ \t]*(Z|[+-]\d\d?(?::?\d\d)?)?)?\Z")


@dataclass(eq=False)
class Node:
    kind: str  # null, bool, int, float, string, sequence, mapping, set, omap, pairs, alias
    value: Any = None  # text of a scalar, list of nodes, list of (key, value) nodes, name of an alias
    tag: str | None = None
    anchor: str | None = None
    style: str = "PLAIN"
    typed: Any = None  # bool, int, float, timestamp or bytes of a scalar
    target: Node | None = None
    leading_comment: str | None = None
    inline_comment: str | None = None
    offset: int = 0
    line: int = 1
    col: int = 1


@dataclass
class Document:
    root: Node | None
    index: int = 0
    has_merge_keys: bool = False
    anchors: dict[str, Node] = field(default_factory=dict)
    warnings: list[tuple[str, str]] = field(default_factory=list)
    handles: dict[str, str] = field(default_factory=dict)
    explicit_start: bool = False


def decoded(data: bytes) -> str:
    """Text of bytes in UTF-8, UTF-16 or UTF-32, by byte order mark or the zeros of the first character."""
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return _decode(data[len(mark) :], name)
    return _decode(data, "utf-8")


def _decode(data: bytes, name: str) -> str:
    try:
        return data.decode(name)
    except UnicodeDecodeError as e:
        raise TextError("E_INVALID", f"not {name}", e.start) from e


class Parser:
    def __init__(self, text: str, options: YamlParseOptions = YamlParseOptions()):
        self.o = options.effective()
        if len(text) * 4 > self.o.max_total_bytes and len(text.encode("utf-8", "surrogatepass")) > self.o.max_total_bytes:
            raise TextError("E_LIMIT", "input is too long", 0, 1, 1)
        self.t = (text[1:] if text[:1] == "﻿" else text).replace("\r\n", "\n").replace("\r", "\n")
        if self.o.validate_utf8 and J.SURROGATE.search(self.t):
            raise TextError.at("E_INVALID", "lone surrogate", self.t, J.SURROGATE.search(self.t).start())
        self.p, self.depth, self.comment, self.doc = 0, 0, None, None
        self.bad: list[tuple[int, str]] = []

    def fail(self, code: str, message: str, at: int | None = None):
        raise TextError.at(code, message, self.t, self.p if at is None else at)

    # Places

    def col(self, p: int | None = None) -> int:
        p = self.p if p is None else p
        return p - (self.t.rfind("\n", 0, p) + 1)

    def peek(self, n: int = 1) -> str:
        return self.t[self.p : self.p + n]

    def blanks(self) -> None:
        while self.peek() in (" ", "\t") and self.peek():
            self.p += 1

    def at_end(self) -> bool:
        return self.p >= len(self.t)

    def marker(self, p: int | None = None) -> bool:
        p = self.p if p is None else p
        return (p == 0 or self.t[p - 1] == "\n") and self.t[p : p + 3] in ("---", "...") and self.t[p + 3 : p + 4] in ("", " ", "\t", "\n")

    def skip(self) -> None:
        """Over blanks, breaks and comments to the next token; keeps comments of whole lines."""
        while not self.at_end():
            start = self.p
            self.blanks()
            c = self.peek()
            if c == "#" and (self.p == 0 or self.t[self.p - 1] in " \t\n"):
                end = self.t.find("\n", self.p)
                end = len(self.t) if end < 0 else end
                text = self.t[self.p + 1 : end].strip()
                self.comment = text if self.comment is None else f"{self.comment}\n{text}"
                self.p = end
            elif c == "\n":
                self.p += 1
            else:
                line = self.t.rfind("\n", 0, self.p) + 1
                if "\t" in self.t[max(line, start) : self.p] and self.t[line : self.p].strip(" \t") == "" and self.depth_flow == 0 and c and self.t[line : self.p].lstrip(" ")[:1] == "\t":
                    self.fail("E_BAD_TOKEN", "tab in indentation", line)
                return

    depth_flow = 0

    def rest_of_line(self) -> bool:
        """Whether only blanks and a comment follow on this line; the comment goes to ``self.inline``."""
        p = self.p
        self.blanks()
        self.inline = None
        c = self.peek()
        if c == "#" and self.p > p:
            end = self.t.find("\n", self.p)
            end = len(self.t) if end < 0 else end
            self.inline = self.t[self.p + 1 : end].strip()
            self.p = end
            return True
        return c in ("", "\n")

    def node(self, kind: str, value, start: int, **more) -> Node:
        line = self.t.rfind("\n", 0, start) + 1
        return Node(kind, value, offset=len(self.t[:start].encode("utf-8", "surrogatepass")), line=self.t.count("\n", 0, start) + 1, col=start - line + 1, **more)

    # Stream

    def documents(self) -> Iterator[Document]:
        index = 0
        while True:
            self.doc = Document(None, index)
            self.skip()
            directives = False
            while self.peek() == "%" and self.col() == 0:
                self.directive()
                directives = True
                self.skip()
            if self.marker() and self.peek(3) == "...":
                self.p += 3
                continue
            if self.at_end():
                if directives:
                    self.fail("E_BAD_TOKEN", "directives without a document")
                return
            if self.marker():
                self.p += 3
                self.doc.explicit_start = True
            elif directives:
                self.fail("E_BAD_TOKEN", "--- is missing after directives")
            self.doc.root = self.block(-1)
            self.skip()
            if not self.at_end() and not self.marker():
                self.fail("E_BAD_TOKEN", "unexpected content")
            yield self.doc
            index += 1

    def directive(self) -> None:
        end = self.t.find("\n", self.p)
        end = len(self.t) if end < 0 else end
        words = self.t[self.p + 1 : end].split("#")[0].split()
        if words[:1] == ["YAML"]:
            if len(words) != 2 or not re.fullmatch(r"1\.\d+", words[1]):
                self.fail("E_BAD_TOKEN", "bad %YAML directive")
        elif words[:1] == ["TAG"]:
            if len(words) != 3:
                self.fail("E_BAD_TOKEN", "bad %TAG directive")
            self.doc.handles[words[1]] = words[2]
        self.p = end

    # Nodes

    def properties(self) -> tuple[str | None, str | None]:
        tag = anchor = None
        while True:
            c = self.peek()
            if c == "&" and anchor is None and (m := NAME.match(self.t, self.p + 1)):
                anchor = m[0]
                self.p = m.end()
            elif c == "!" and tag is None:
                if self.peek(2) == "!<":
                    end = self.t.find(">", self.p)
                    if end < 0:
                        self.fail("E_BAD_TOKEN", "tag is not closed")
                    tag, self.p = self.t[self.p + 2 : end], end + 1
                else:
                    m = NAME.match(self.t, self.p)
                    tag, self.p = self.tag(m[0]), m.end()
            else:
                return tag, anchor
            if self.peek() not in ("", " ", "\t", "\n") and not (self.depth_flow and self.peek() in ",[]{}"):
                self.fail("E_BAD_TOKEN", "a blank must follow")
            self.blanks()

    def tag(self, text: str) -> str:
        m = re.match(r"!([^!]*)!(.+)", text)
        if not m:
            return text if text == "!" or "!" not in self.doc.handles else self.doc.handles["!"] + text[1:]
        handle = f"!{m[1]}!"
        if handle in self.doc.handles:
            return self.doc.handles[handle] + m[2]
        if handle == "!!":
            return TAG_PREFIX + m[2]
        return self.fail("E_INVALID", f"unknown tag handle {handle}")

    def enter(self) -> None:
        self.depth += 1
        if self.depth > self.o.max_depth:
            self.fail("E_DEPTH", "nesting is too deep")

    def named(self, n: Node, tag, anchor) -> Node:
        n.tag, n.anchor = tag or n.tag, anchor or n.anchor
        if anchor:
            self.doc.anchors[anchor] = n
        return n

    def alias(self) -> Node:
        m = NAME.match(self.t, self.p + 1)
        if not m:
            self.fail("E_BAD_TOKEN", "an alias needs a name")
        if not self.o.allow_aliases:
            self.fail("E_INVALID", "aliases are not allowed")
        name = m[0]
        if name not in self.doc.anchors:
            if name.endswith(":") and name[:-1] in self.doc.anchors:
                name = name[:-1]
            else:
                self.fail("E_INVALID", f"unknown alias {name!r}")
        n = self.node("alias", name, self.p, target=self.doc.anchors[name])
        self.p += 1 + len(name)
        return n

    def block(self, parent: int, same: bool = False) -> Node:
        """A node indented more than ``parent``; with ``same`` also a sequence at its column."""
        tag = anchor = None
        comment, self.comment = None, None
        while True:
            self.skip()
            comment, self.comment = self.comment or comment, None
            col = self.col()
            seq = self.peek() == "-" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n")
            if self.at_end() or self.marker() or col < parent or col == parent and not (same and seq):
                self.comment = comment
                return self.named(self.node("null", "", self.p), tag, anchor)
            start = self.p
            if self.peek() in ("&", "!"):
                if self.key_here():
                    n = self.block_mapping(col)
                    break
                line = self.t.find("\n", self.p)
                t, a = self.properties()
                tag, anchor = t or tag, a or anchor
                if self.rest_of_line():
                    continue
                if self.p > (len(self.t) if line < 0 else line):
                    continue
                n = self.content(parent, self.col())
                break
            if seq:
                n = self.block_sequence(col)
            elif self.peek() == "?" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n") or self.key_here():
                n = self.block_mapping(col)
            else:
                n = self.content(parent, col)
            break
        if comment is not None and n.leading_comment is None:
            n.leading_comment = comment
        if n.kind != "alias" and not n.offset:
            n.offset = len(self.t[:start].encode("utf-8", "surrogatepass"))
        return self.named(n, tag, anchor)

    def content(self, parent: int, col: int) -> Node:
        """A node that is no block collection: alias, block scalar, flow, quoted or plain."""
        c, start = self.peek(), self.p
        if c == "*":
            n = self.alias()
        elif c in ("|", ">"):
            return self.block_scalar(parent)
        elif c in ("[", "{"):
            n = self.flow(parent)
        elif c in ('"', "'"):
            n = self.quoted(parent)
        else:
            n = self.plain(parent, False)
        if not self.rest_of_line():
            self.fail("E_BAD_TOKEN", "unexpected text after a value")
        n.inline_comment = self.inline
        del start
        return n

    def key_here(self) -> bool:
        """Whether an implicit key stands here: one line, then a colon and a blank."""
        saved = self.p, self.comment, dict(self.doc.anchors), self.depth
        line = self.t.find("\n", self.p)
        line = len(self.t) if line < 0 else line
        if ":" not in self.t[self.p : line]:
            return False
        try:
            self.key()
            self.blanks()
            return self.p < line and self.peek() == ":" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n")
        except TextError:
            return False
        finally:
            self.p, self.comment, self.doc.anchors, self.depth = saved

    def key(self) -> Node:
        start, line = self.p, self.t.find("\n", self.p)
        tag, anchor = self.properties()
        c = self.peek()
        if c == "*":
            n = self.alias()
        elif c in ('"', "'"):
            n = self.quoted(-1)
        elif c in ("[", "{"):
            n = self.flow(-1)
        elif c == ":" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n"):
            n = self.node("null", "", self.p)
        else:
            n = self.plain(-1, False, one_line=True)
        if 0 <= line < self.p:
            self.fail("E_BAD_TOKEN", "a key must be on one line", start)
        return self.named(n, tag, anchor)

    def block_sequence(self, col: int) -> Node:
        self.enter()
        n = self.node("sequence", [], self.p, style="BLOCK")
        while not self.at_end() and not self.marker() and self.col() == col and self.peek() == "-" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n"):
            self.p += 1
            n.value.append(self.block(col))
            self.skip()
        if not self.at_end() and not self.marker() and self.col() > col:
            self.fail("E_BAD_TOKEN", "bad indentation")
        self.depth -= 1
        return n

    def block_mapping(self, col: int) -> Node:
        self.enter()
        n = self.node("mapping", [], self.p, style="BLOCK")
        while True:
            explicit = self.peek() == "?" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n")
            comment, self.comment = self.comment, None
            if explicit:
                self.p += 1
                key = self.block(col)
                self.skip()
                if self.peek() == ":" and self.col() == col and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n"):
                    self.p += 1
                    value = self.value_after_colon(col, True)
                else:
                    value = self.node("null", "", self.p)
            else:
                if not self.key_here():
                    self.fail("E_BAD_TOKEN", "a key and a colon are needed")
                key = self.key()
                self.blanks()
                self.p += 1
                value = self.value_after_colon(col, False)
            if comment is not None:
                key.leading_comment = comment
            n.value.append((key, value))
            self.skip()
            if self.at_end() or self.marker() or self.col() < col:
                break
            if self.col() > col:
                self.fail("E_BAD_TOKEN", "bad indentation")
            if self.peek() == "-" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\n") and not self.key_here():
                break
        self.depth -= 1
        return n

    def value_after_colon(self, col: int, explicit: bool) -> Node:
        if self.rest_of_line():
            inline = self.inline
            n = self.block(col, same=True)
            if inline is not None and n.kind in ("sequence", "mapping"):
                n.inline_comment = inline
            return n
        if explicit:
            return self.block(col, same=True)
        tag, anchor = self.properties()
        if self.rest_of_line():
            return self.named(self.block(col, same=True), tag, anchor)
        if self.peek() == "-" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n"):
            self.fail("E_BAD_TOKEN", "a sequence cannot start on its key's line")
        if self.key_here():
            self.fail("E_BAD_TOKEN", "a mapping cannot start on its key's line")
        return self.named(self.content(col, self.col()), tag, anchor)

    # Scalars

    def plain(self, parent: int, flow: bool, one_line: bool = False) -> Node:
        start, c = self.p, self.peek()
        after = self.t[self.p + 1 : self.p + 2]
        stop = ",[]{}" if flow else ""
        if not c or c in "#&*!|>'\"%@`" or c in ",[]{}" or c in "-?:" and (after in ("", " ", "\t", "\n") or flow and after in ",[]{}"):
            self.fail("E_BAD_TOKEN", f"unexpected {c!r}" if c else "a value is missing")
        parts, gap = [], 0
        while True:
            p = self.p
            while p < len(self.t):
                c = self.t[p]
                nxt = self.t[p + 1 : p + 2]
                if c == "\n" or c in stop or c == ":" and (nxt in ("", " ", "\t", "\n") or flow and nxt in ",[]{}") or c == "#" and p > start and self.t[p - 1] in " \t":
                    break
                p += 1
            text = self.t[self.p : p].rstrip(" \t")
            parts.append(("" if not parts else " " if gap == 1 else "\n" * (gap - 1)) + text)
            self.p = self.p + len(text)
            if one_line or p < len(self.t) and self.t[p] != "\n":
                break
            q, gap = p, 0
            while q < len(self.t) and self.t[q] in " \t\n":
                gap += self.t[q] == "\n"
                q += 1
            if q >= len(self.t) or self.t[q] == "#" or self.marker(q) or q - (self.t.rfind("\n", 0, q) + 1) <= parent:
                break
            if flow and self.t[q] in ",[]{}:":
                break
            if not flow:
                here, self.p = self.p, q
                if self.key_here():
                    if parent < 0 and self.col(start) == self.col(q):
                        self.p = here
                        break
                    self.fail("E_BAD_TOKEN", "a key inside a plain scalar")
            self.p = q
        return self.node("string", "".join(parts), start)

    def quoted(self, parent: int) -> Node:
        start, q = self.p, self.peek()
        out: list[str] = []
        p, t = start + 1, self.t
        while True:
            if p >= len(t):
                self.fail("E_INCOMPLETE", "quote is not closed", start)
            c = t[p]
            if c == q:
                if q == "'" and t[p + 1 : p + 2] == "'":
                    out.append("'")
                    p += 2
                    continue
                break
            if c == "\\" and q == '"':
                v, p = self.escape(p)
                out.append(v)
            elif c == "\n":
                while out and out[-1] in (" ", "\t"):
                    out.pop()
                n = 0
                while p < len(t) and t[p] in " \t\n":
                    n += t[p] == "\n"
                    p += 1
                if self.marker(p):
                    self.fail("E_BAD_TOKEN", "document marker in quotes", p)
                out.append(" " if n == 1 else "\n" * (n - 1))
            else:
                out.append(c)
                p += 1
        self.p = p + 1
        return self.node("string", "".join(out), start, style="DOUBLE_QUOTED" if q == '"' else "SINGLE_QUOTED")

    def escape(self, p: int) -> tuple[str, int]:
        c = self.t[p + 1 : p + 2]
        if c == "\n":
            q = p + 2
            while self.t[q : q + 1] in (" ", "\t") and self.t[q : q + 1]:
                q += 1
            return "", q
        if c in ("x", "u", "U"):
            n = {"x": 2, "u": 4, "U": 8}[c]
            h = self.t[p + 2 : p + 2 + n]
            if not re.fullmatch(rf"[0-9a-fA-F]{{{n}}}", h) or int(h, 16) > 0x10FFFF:
                self.fail("E_BAD_ESCAPE", "bad hexadecimal escape", p)
            v, end = int(h, 16), p + 2 + n
            if 0xD800 <= v < 0xDC00 and re.match(r"\\u[dD][c-fC-F]", self.t[end : end + 4]):
                return chr(0x10000 + ((v - 0xD800) << 10) + int(self.t[end + 2 : end + 6], 16) - 0xDC00), end + 6
            if 0xD800 <= v < 0xE000:
                self.fail("E_BAD_ESCAPE", "lone surrogate", p)
            return chr(v), end
        return ESCAPES.get(c, c), p + 2

    def block_scalar(self, parent: int) -> Node:
        start = self.p
        m = re.compile(r"([|>])(?:([+-])([1-9])?|([1-9])([+-])?)?").match(self.t, self.p)
        chomp, width = m[2] or m[5] or "", m[3] or m[4]
        self.p = m.end()
        if not self.rest_of_line():
            self.fail("E_BAD_TOKEN", "text after a block scalar's header")
        inline = self.inline
        end = self.t.find("\n", self.p)
        self.p = len(self.t) if end < 0 else end + 1
        indent = max(parent, 0) + int(width) if width else None
        if width and parent < 0:
            indent = int(width)
        lines: list[str] = []
        while self.p < len(self.t):
            end = self.t.find("\n", self.p)
            stop = len(self.t) if end < 0 else end
            line = self.t[self.p : stop]
            lead = len(line) - len(line.lstrip(" "))
            if line.strip(" ") == "":
                lines.append(line[indent:] if indent is not None else "")
            else:
                if self.marker():
                    break
                if indent is None:
                    if lead <= parent:
                        break
                    indent = lead
                if lead < indent:
                    break
                lines.append(line[indent:])
            self.p = stop + (end >= 0)
        tail = 0
        while lines and lines[-1] == "":
            lines.pop()
            tail += 1
        if m[1] == "|":
            text = "\n".join(lines)
        else:
            text, more, blank = "", True, 0
            for k, line in enumerate(lines):
                if line == "":
                    blank += 1
                    continue
                deep = line[0] in " \t"
                if k and not (text == "" and blank == k):
                    text += "\n" * (blank + 1) if deep or more else "\n" * blank if blank else " "
                elif blank:
                    text += "\n" * blank
                text, more, blank = text + line, deep, 0
        if chomp == "+" and (lines or tail):
            text += "\n" * (tail + bool(lines))
        n = self.node("string", text, start, style="LITERAL" if m[1] == "|" else "FOLDED")
        n.inline_comment = inline
        if self.p > 0 and self.p <= len(self.t) and self.t[self.p - 1 : self.p] == "\n":
            self.p -= 1
        return n

    # Flow

    def flow(self, parent: int) -> Node:
        self.enter()
        self.depth_flow += 1
        start, mapping = self.p, self.peek() == "{"
        close = "}" if mapping else "]"
        n = self.node("mapping" if mapping else "sequence", [], start, style="FLOW")
        self.p += 1
        while True:
            self.skip()
            if self.at_end() or self.marker():
                self.fail("E_INCOMPLETE", f"{close} is missing", start)
            if self.peek() == close:
                self.p += 1
                break
            explicit = self.peek() == "?" and self.t[self.p + 1 : self.p + 2] in (" ", "\t", "\n")
            if explicit:
                self.p += 1
                self.skip()
            key = self.flow_node(parent)
            quoted = key.style in ("DOUBLE_QUOTED", "SINGLE_QUOTED", "FLOW")
            self.skip()
            pair = self.peek() == ":" and (quoted or self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n", ",", "[", "]", "{", "}"))
            value = None
            if pair:
                self.p += 1
                self.skip()
                value = self.node("null", "", self.p) if self.peek() in (",", close) else self.flow_node(parent)
            elif mapping or explicit:
                value = self.node("null", "", self.p)
            if mapping:
                n.value.append((key, value))
            else:
                n.value.append(key if value is None else self.node("mapping", [(key, value)], start, style="FLOW"))
            self.skip()
            if self.peek() == ",":
                self.p += 1
            elif self.peek() != close:
                self.fail("E_BAD_TOKEN" if not self.at_end() else "E_INCOMPLETE", f"a comma or {close} is needed")
        self.depth_flow -= 1
        self.depth -= 1
        return n

    def flow_node(self, parent: int) -> Node:
        tag, anchor = self.properties()
        self.skip()
        c = self.peek()
        if c == "*":
            n = self.alias()
        elif c in ("[", "{"):
            n = self.flow(parent)
        elif c in ('"', "'"):
            n = self.quoted(parent)
        elif c in (",", "]", "}") or c == ":" and self.t[self.p + 1 : self.p + 2] in ("", " ", "\t", "\n", ",", "]", "}"):
            n = self.node("null", "", self.p)
        else:
            n = self.plain(-1, True)
        return self.named(n, tag, anchor)


# Resolution

NULLS = {"~", "null", ""}
INT = re.compile(r"[+-]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)\Z")
FLOAT = re.compile(r"[+-]?(?:\.[0-9][0-9_]*|[0-9][0-9_]*(?:\.[0-9_]*)?)(?:[eE][+-]?[0-9]+)?\Z")
SIXTIES = re.compile(r"[+-]?[0-9][0-9_]*(?::[0-5]?[0-9])+(?:\.[0-9_]*)?\Z")


def as_bool(v: str, o: YamlParseOptions) -> bool | None:
    low = v if o.schema == "JSON" else v.lower()
    if low in ("true", "false"):
        return low == "true"
    if o.yaml_1_1 and low in ("yes", "on", "y", "no", "off", "n"):
        return low in ("yes", "on", "y")
    return None


def as_int(v: str, o: YamlParseOptions) -> int | None:
    if o.yaml_1_1 and SIXTIES.match(v) and "." not in v:
        total = 0
        for part in v.lstrip("+-").replace("_", "").split(":"):
            total = total * 60 + int(part)
        return -total if v[0] == "-" else total
    if not INT.match(v):
        return None
    sign, body = (-1 if v[0] == "-" else 1), v.lstrip("+-").replace("_", "")
    base = {"0b": 2, "0o": 8, "0x": 16}.get(body[:2].lower())
    try:
        if base:
            n = int(body[2:], base)
        elif len(body) > 1 and body[0] == "0":
            if not o.yaml_1_1 or re.search("[89]", body):
                return None
            n = int(body, 8)
        else:
            n = int(body)
    except ValueError:
        return None
    return sign * n if -(1 << 63) <= sign * n < 1 << 63 else None


def as_float(v: str, o: YamlParseOptions) -> float | None:
    low = v.lower().lstrip("+-")
    if low == ".inf" and v[0:2] not in ("+-", "-+"):
        return float("-inf") if v[0] == "-" else float("inf")
    if low == ".nan" and v.lower() == ".nan":
        return float("nan")
    if o.yaml_1_1 and SIXTIES.match(v) and "." in v:
        total = 0.0
        for part in v.lstrip("+-").replace("_", "").split(":"):
            total = total * 60 + float(part)
        return -total if v[0] == "-" else total
    if FLOAT.match(v) and ("." in v or "e" in low):
        try:
            return float(v.replace("_", ""))
        except ValueError:
            return None
    return None


def as_timestamp(v: str) -> dict | None:
    m = STAMP.match(v)
    if not m:
        return None
    y, mo, d = int(m[1]), int(m[2]), int(m[3])
    days = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if not 1 <= mo <= 12 or not 1 <= d <= days[mo - 1]:
        return None
    out = {"has_time": m[4] is not None, "tz_specified": m[8] is not None, "tz_utc": m[8] == "Z", "year": y, "month": mo, "day": d, "hour": 0, "minute": 0, "second": 0, "nsec": 0, "tz_offset": 0}
    if m[4]:
        h, mi, s = int(m[4]), int(m[5]), int(m[6])
        if h > 23 or mi > 59 or s > 60:
            return None
        out |= {"hour": h, "minute": mi, "second": s, "nsec": int((m[7] or "0").ljust(9, "0"))}
        if m[8] and m[8] != "Z":
            z = m[8][1:].replace(":", "").zfill(4) if len(m[8]) > 3 else m[8][1:].zfill(2) + "00"
            out["tz_offset"] = (-1 if m[8][0] == "-" else 1) * (int(z[:2]) * 60 + int(z[2:]))
    return out


def short(tag: str | None) -> str | None:
    return None if tag is None else tag[len(TAG_PREFIX) :] if tag.startswith(TAG_PREFIX) else tag


def resolve(doc: Document, options: YamlParseOptions = YamlParseOptions()) -> Document:
    o = options.effective()
    custom = {c.tag: c for c in o.custom_tags} if o.enable_custom_tags else {}
    sizes: dict[int, int] = {}
    seen: set[int] = set()
    budget = 0

    def size(n: Node, open_: tuple[int, ...] = ()) -> int:
        """Nodes that a full expansion of ``n`` has."""
        if n.kind == "alias":
            if id(n.target) in open_:
                raise TextError("E_INVALID", f"alias {n.value!r} is in its own target")
            return size(n.target, open_)
        if id(n) not in sizes:
            inner = (*open_, id(n))
            kids = [x for kv in n.value for x in kv] if n.kind in ("mapping", "set", "omap", "pairs") else n.value if n.kind == "sequence" else []
            sizes[id(n)] = 1 + sum(size(x, inner) for x in kids)
            if sizes[id(n)] > o.max_alias_expansion * 1000:
                raise TextError("E_LIMIT", "aliases expand too far")
        return sizes[id(n)]

    def scalar(n: Node) -> None:
        tag = short(n.tag)
        if n.tag in custom or tag in custom:
            c = custom.get(n.tag) or custom[tag]
            n.kind = "string"
            n.typed = c.construct(n.value) if c.construct else None
            return
        plain = n.style == "PLAIN"
        v = n.value

        def need(x, name: str):
            return TextError("E_INVALID", f"{v!r} is no {name}") if x is None else x

        if tag in ("str", "!") or tag is None and not plain or tag is not None and tag not in STANDARD:
            n.kind = "string"
        elif tag == "null":
            n.kind = "null"
        elif tag in ("bool", "int", "float"):
            x = {"bool": as_bool, "int": as_int, "float": lambda s, q: as_float(s, q) if as_float(s, q) is not None else None if as_int(s, q) is None else float(as_int(s, q))}[tag](v, o)
            if x is None:
                raise need(x, tag)
            n.kind, n.typed = tag, x
        elif tag == "timestamp":
            n.kind, n.typed = "string", as_timestamp(v)
            if n.typed is None:
                raise need(None, "timestamp")
        elif tag == "binary":
            try:
                n.typed = base64.b64decode(re.sub(r"\s", "", v), validate=True)
            except ValueError as e:
                raise TextError("E_INVALID", "bad base64") from e
            n.kind, n.value = "string", base64.b64encode(n.typed).decode()
        elif o.schema == "FAILSAFE":
            n.kind = "null" if n.kind == "null" and v == "" else "string"
        elif v == "null" or v == "" and n.kind == "null" or o.schema != "JSON" and v.lower() in NULLS:
            n.kind = "null"
        elif (b := as_bool(v, o)) is not None:
            n.kind, n.typed = "bool", b
            if o.yaml_1_1 and v.lower() not in ("true", "false"):
                doc.warnings.append(("YAML_1_1", f"{v!r} is a boolean in YAML 1.1 only"))
        elif (i := as_int(v, o)) is not None:
            n.kind, n.typed = "int", i
        elif (f := as_float(v, o)) is not None:
            n.kind, n.typed = "float", f
        else:
            n.kind = "string"

    def is_merge(k: Node) -> bool:
        return k.kind in ("string", "null") and (k.value == "<<" and k.style == "PLAIN" and k.tag is None or short(k.tag) == "merge")

    def deref(n: Node) -> Node:
        return n.target if n.kind == "alias" else n

    def merge(n: Node) -> None:
        if not any(is_merge(k) for k, _ in n.value):
            return
        if not o.allow_merge_keys:
            raise TextError("E_INVALID", "merge keys are not allowed")
        doc.has_merge_keys = True
        merged: list[tuple[Node, Node]] = []

        def take(source: Node) -> None:
            source = deref(source)
            if source.kind != "mapping":
                raise TextError("E_INVALID", "a merge key needs mappings")
            for k, v in source.value:
                for i, (have, _) in enumerate(merged):
                    if same(have, k):
                        merged[i] = (k, v)  # a later source wins
                        break
                else:
                    merged.append((k, v))

        own = [(k, v) for k, v in n.value if not is_merge(k)]
        for k, v in n.value:
            if is_merge(k):
                v = deref(v)
                for s in v.value if v.kind == "sequence" else [v]:
                    take(s)
        n.value = [(k, next((b for a, b in own if same(a, k)), v)) for k, v in merged] + [(k, v) for k, v in own if not any(same(k, a) for a, _ in merged)]

    def same(a: Node, b: Node) -> bool:
        a, b = deref(a), deref(b)
        if a.kind != b.kind:
            return False
        if a.kind in ("bool", "int", "float"):
            return a.typed == b.typed
        if a.kind in ("null", "string"):
            return a.kind == "null" or a.value == b.value
        if a.kind == "sequence":
            return len(a.value) == len(b.value) and all(map(same, a.value, b.value))
        return len(a.value) == len(b.value) and all(any(same(k, q) and same(v, w) for q, w in b.value) for k, v in a.value)

    def signature(k: Node):
        k = deref(k)
        return (k.kind, k.typed if k.kind in ("bool", "int", "float") else k.value if k.kind == "string" else None) if not isinstance(k.value, list) else (k.kind, len(k.value))

    def duplicates(n: Node) -> None:
        at: dict[Any, list[int]] = {}
        out: list[tuple[Node, Node] | None] = []
        for k, v in n.value:
            hit = next((i for i in at.get(signature(k), []) if out[i] is not None and same(out[i][0], k)), None)
            if hit is None or o.dupkeys == "LAST_WINS":
                if hit is not None:
                    out[hit] = None
                    doc.warnings.append(("DUPKEY", f"key {k.value!r} twice"))
                at.setdefault(signature(k), []).append(len(out))
                out.append((k, v))
            elif o.dupkeys == "ERROR":
                raise TextError("E_DUPKEY", f"key {k.value!r} twice", k.offset, k.line, k.col)
            else:
                doc.warnings.append(("DUPKEY", f"key {k.value!r} twice"))
        n.value = [x for x in out if x is not None]

    def walk(n: Node) -> None:
        nonlocal budget
        if n.kind == "alias":
            budget += size(n.target)
            if budget > o.max_alias_expansion:
                raise TextError("E_LIMIT", "aliases expand too far", n.offset, n.line, n.col)
            return
        if id(n) in seen:
            return
        seen.add(id(n))
        tag = short(n.tag)
        if tag not in (None, "!") and tag not in STANDARD and not o.allow_nonstandard_tags and n.tag not in custom:
            raise TextError("E_INVALID", f"tag {n.tag!r} is not allowed", n.offset, n.line, n.col)
        if n.kind == "sequence":
            for x in n.value:
                walk(x)
            if tag in ("omap", "pairs"):
                pairs = []
                for x in map(deref, n.value):
                    if x.kind != "mapping" or len(x.value) != 1:
                        raise TextError("E_INVALID", f"!!{tag} needs mappings of one pair")
                    pairs.append(x.value[0])
                if tag == "omap" and any(same(pairs[i][0], pairs[j][0]) for i in range(len(pairs)) for j in range(i)):
                    raise TextError("E_DUPKEY", "!!omap key twice")
                n.kind, n.value = tag, pairs
        elif n.kind == "mapping":
            for k, v in n.value:
                walk(k)
                walk(v)
                if not o.allow_complex_keys and deref(k).kind in ("sequence", "mapping"):
                    raise TextError("E_INVALID", "complex keys are not allowed", k.offset, k.line, k.col)
                if o.require_string_keys and not is_merge(k) and deref(k).kind != "string":
                    raise TextError("E_INVALID", "keys must be strings", k.offset, k.line, k.col)
            merge(n)
            duplicates(n)
            if tag == "set":
                if any(deref(v).kind != "null" for _, v in n.value):
                    raise TextError("E_INVALID", "!!set values must be null")
                n.kind = "set"
        elif o.resolve_tags:
            scalar(n)

    if doc.root is not None:
        for a in doc.anchors.values():
            size(a)
        walk(doc.root)
    if o.warnings_as_errors and doc.warnings:
        raise TextError("E_INVALID", doc.warnings[0][1])
    return doc


def parse_all(text: str, options: YamlParseOptions = YamlParseOptions()) -> list[Document]:
    return [resolve(d, options) for d in Parser(text, options).documents()]


def parse(text: str, options: YamlParseOptions = YamlParseOptions()) -> Document:
    """The first document; an empty stream has an empty one."""
    o = options.effective()
    if o.enable_json_fast_path and text.lstrip()[:1] in ("{", "["):
        try:
            policy = o.dupkeys
            return resolve(_from_json(J.parse(text, JsonParseOptions(dupkeys=policy, max_depth=o.max_depth))), options)
        except TextError as e:
            if e.code in ("E_DUPKEY", "E_DEPTH"):
                raise
    for d in Parser(text, options).documents():
        return resolve(d, options)
    return Document(None)


def parse_json(text: str, options: YamlParseOptions = YamlParseOptions()) -> Document:
    return resolve(_from_json(J.parse(text, JsonParseOptions(dupkeys=options.dupkeys, max_depth=options.max_depth))), options)


def _from_json(value) -> Document:
    def node(v) -> Node:
        if isinstance(v, list):
            return Node("sequence", [node(x) for x in v], style="FLOW")
        if isinstance(v, dict):
            return Node("mapping", [(node(k), node(x)) for k, x in v.items()], style="FLOW")
        if isinstance(v, str):
            return Node("string", v, style="DOUBLE_QUOTED")
        return Node("string", "null" if v is None else "true" if v is True else "false" if v is False else v.lexeme)

    return Document(node(value))


def parse_partial(text: str, options: YamlParseOptions = YamlParseOptions()) -> tuple[Document, list[TextError]]:
    """The document as far as it can be read, and the errors: from the line of an error on, lines are dropped until the rest parses."""
    errors: list[TextError] = []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for _ in range(len(lines) + 1):
        try:
            return parse("\n".join(lines), options), errors
        except TextError as e:
            errors.append(e)
            at = (e.line or len(lines)) - 1
            if not lines:
                break
            del lines[min(at, len(lines) - 1)]
    return Document(None), errors


def events(text: str, options: YamlParseOptions = YamlParseOptions()):
    """Yields (type, value, tag, anchor, style) of the stream."""
    def walk(n: Node):
        if n.kind == "alias":
            yield "ALIAS", n.value, None, None, None
        elif n.kind in ("sequence", "mapping"):
            name = n.kind.upper()
            yield f"{name}_START", None, n.tag, n.anchor, n.style
            for x in n.value if n.kind == "sequence" else [y for kv in n.value for y in kv]:
                yield from walk(x)
            yield f"{name}_END", None, None, None, None
        else:
            yield "SCALAR", n.value, n.tag, n.anchor, n.style

    yield "STREAM_START", None, None, None, None
    for d in Parser(text, options).documents():
        yield "DOCUMENT_START", None, None, None, None
        if d.root is not None:
            yield from walk(d.root)
        yield "DOCUMENT_END", None, None, None, None
    yield "STREAM_END", None, None, None, None


def nodes(doc: Document):
    """The node table: dicts in document order; an alias has its target's id."""
    ids: dict[int, int] = {}
    out: list[dict] = []

    def walk(n: Node, parent, depth, ordinal, key, role, path):
        me = ids[id(n)] = len(out)
        t = n.typed
        out.append({
            "doc_index": doc.index, "node_id": me, "parent_id": parent, "depth": depth, "ordinal": ordinal, "key": key, "role": role, "path": path, "kind": n.kind,
            "value": n.value if isinstance(n.value, str) else None, "bool": t if n.kind == "bool" else None, "i64": t if n.kind == "int" else None, "dbl": t if n.kind == "float" else None,
            "tag": n.tag, "anchor": n.anchor, "alias_target_id": ids.get(id(n.target)) if n.kind == "alias" else None, "style": n.style,
            "leading_comment": n.leading_comment, "inline_comment": n.inline_comment, "offset": n.offset, "line": n.line, "col": n.col,
            "bin": t if isinstance(t, bytes) else None,
        })
        if n.kind == "sequence":
            for i, x in enumerate(n.value):
                walk(x, me, depth + 1, i, None, "item", f"{path}/{i}")
        elif isinstance(n.value, list):
            for i, (k, v) in enumerate(n.value):
                name = k.value if isinstance(k.value, str) else None
                step = f"{path}/{(name or '').replace('~', '~0').replace('/', '~1')}"
                walk(k, me, depth + 1, i, name, "key", step)
                walk(v, me, depth + 1, i, name, "value", step)

    if doc.root is not None:
        walk(doc.root, None, 0, 0, None, "item", "")
    return out


# Accessors and edits

def deref(n: Node | None) -> Node | None:
    return n.target if n is not None and n.kind == "alias" else n


def mapping_get(n: Node | None, key: str) -> Node | None:
    """The value of the first string key that equals ``key``; keys of other types never match."""
    n = deref(n)
    if n is None or n.kind not in ("mapping", "set", "omap", "pairs"):
        return None
    return next((v for k, v in n.value if deref(k).kind == "string" and deref(k).value == key), None)


def sequence_get(n: Node | None, i: int) -> Node | None:
    n = deref(n)
    return n.value[i] if n is not None and n.kind == "sequence" and 0 <= i < len(n.value) else None


def size_of(n: Node | None) -> int:
    n = deref(n)
    return len(n.value) if n is not None and isinstance(n.value, list) else 0


def point(doc: Document, pointer: str) -> Node | None:
    n = doc.root
    for t in J.tokens_of(pointer):
        n = sequence_get(n, J.index_of(t)) if deref(n) is not None and deref(n).kind == "sequence" and J.index_of(t) is not None else mapping_get(n, t)
        if n is None:
            return None
    return n


def new_scalar(value: str, tag: str | None = None, anchor: str | None = None) -> Node:
    return Node("string", value, tag, anchor)


def new_collection(kind: str, tag: str | None = None, anchor: str | None = None) -> Node:
    return Node(kind, [], tag, anchor, style="BLOCK")


def set_typed(n: Node, v: bool | int | float) -> None:
    n.kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float"
    n.typed, n.value, n.style = v, str(v).lower() if isinstance(v, bool) else repr(v), "PLAIN"


def mapping_set(n: Node, key: Node, value: Node) -> None:
    """Replaces the value of an equal string key in its place, else appends."""
    for i, (k, _) in enumerate(n.value):
        if k.kind == key.kind == "string" and k.value == key.value:
            n.value[i] = (k, value)
            return
    n.value.append((key, value))


def mapping_delete(n: Node, key: str) -> bool:
    for i, (k, _) in enumerate(n.value):
        if k.kind == "string" and k.value == key:
            del n.value[i]
            return True
    return False


def sequence_insert(n: Node, i: int, child: Node) -> bool:
    if not 0 <= i <= len(n.value):
        return False
    n.value.insert(i, child)
    return True


def sequence_remove(n: Node, i: int) -> bool:
    if not 0 <= i < len(n.value):
        return False
    del n.value[i]
    return True


def clone(n: Node, made: dict[int, Node] | None = None) -> Node:
    """A deep copy; aliases of copied nodes point to the copies."""
    made = {} if made is None else made
    if id(n) in made:
        return made[id(n)]
    c = made[id(n)] = Node(n.kind, None, n.tag, n.anchor, n.style, n.typed, None, n.leading_comment, n.inline_comment, n.offset, n.line, n.col)
    if n.kind == "sequence":
        c.value = [clone(x, made) for x in n.value]
    elif isinstance(n.value, list):
        c.value = [(clone(k, made), clone(v, made)) for k, v in n.value]
    else:
        c.value = n.value
    if n.kind == "alias":
        c.target = clone(n.target, made)
    return c


# JSON

SAFE_INT = (1 << 53) - 1


def to_json(doc: Document, o: YamlToJsonOptions = YamlToJsonOptions()):
    """A JSON value (see ``json_model``) of a resolved document."""
    if doc.has_merge_keys and not o.allow_merge_keys:
        raise TextError("E_INVALID", "merge keys have no JSON form")
    custom = {c.tag: c for c in o.custom_tags}

    def key(k: Node) -> str:
        k = deref(k)
        if k.kind == "string":
            return k.value
        if o.coerce_keys_to_strings and k.kind in ("bool", "int", "float", "null"):
            return "null" if k.kind == "null" else k.value
        raise TextError("E_INVALID", "a JSON key must be a string", k.offset, k.line, k.col)

    def value(n: Node, open_: tuple[int, ...]):
        if n.kind == "alias":
            if not o.allow_resolved_aliases:
                raise TextError("E_INVALID", "aliases have no JSON form", n.offset, n.line, n.col)
            if id(n.target) in open_:
                raise TextError("E_INVALID", "an alias is in its own target")
            return value(n.target, open_)
        tag = short(n.tag)
        if n.tag in custom and custom[n.tag].to_json:
            return custom[n.tag].to_json(n)
        if tag not in (None, "!") and tag not in ("null", "bool", "int", "float", "str", "seq", "map"):
            raise TextError("E_INVALID", f"tag {n.tag!r} has no JSON form", n.offset, n.line, n.col)
        inner = (*open_, id(n))
        if n.kind == "sequence":
            return [value(x, inner) for x in n.value]
        if n.kind == "mapping":
            return {key(k): value(v, inner) for k, v in n.value}
        if n.kind == "null":
            return None
        if n.kind == "bool":
            return n.typed
        if n.kind == "int":
            if abs(n.typed) > SAFE_INT:
                if o.large_int_policy == "ERROR":
                    raise TextError("E_INVALID", "integer exceeds the safe range of JSON", n.offset, n.line, n.col)
                return n.value if o.large_int_policy == "STRING" else J.Number(J.double_text(float(n.typed)))
            return J.Number(str(n.typed))
        if n.kind == "float":
            if n.typed != n.typed or n.typed in (float("inf"), float("-inf")):
                raise TextError("E_INVALID", "JSON has no such number", n.offset, n.line, n.col)
            return J.Number(n.value if J.NUMBER.fullmatch(n.value) else repr(n.typed))
        return n.value

    return None if doc.root is None else value(doc.root, ())


# Writing

def _plain_ok(v: str) -> bool:
    if v == "" or v != v.strip() or v[0] in "-?:,[]{}#&*!|>'\"%@`" or v[-1] == ":" or any(x in v for x in (": ", " #", "\n", "\t", "[", "]", "{", "}", ",")):
        return False
    return J.NEEDS.search(v) is None or "\\" in v and not re.search(r'["\x00-\x1f]', v)


def _escaped(v: str) -> str:
    names = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", "\a": "\\a", "\b": "\\b", "\v": "\\v", "\f": "\\f", "\x1b": "\\e"}
    return '"' + "".join(names.get(c) or (f"\\x{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c) for c in v) + '"'


class Writer:
    def __init__(self, o: YamlWriteOptions = YamlWriteOptions()):
        self.o, self.custom = o, {c.tag: c for c in o.custom_tags}

    def prefix(self, n: Node) -> str:
        tag = n.tag
        shown = "" if tag in (None, "") else f"!!{short(tag)} " if tag.startswith(TAG_PREFIX) else f"{tag} " if tag.startswith("!") else f"!<{tag}> "
        return (f"&{n.anchor} " if n.anchor else "") + shown

    def scalar(self, n: Node, indent: int, flow: bool) -> str:
        if n.tag in self.custom and self.custom[n.tag].represent:
            return self.custom[n.tag].represent(n)
        v, style = n.value or "", self.o.scalar_style if self.o.scalar_style != "PLAIN" else n.style
        if self.o.canonical:
            return _escaped(v)
        if n.kind in ("null", "bool", "int", "float") and n.style == "PLAIN":
            return v or "null"
        if style in ("LITERAL", "FOLDED") and not flow and not re.search(r"[\x00-\x09\x0b-\x1f]", v) and v.strip(" \n"):
            return self.block(v, style, indent)
        if style == "SINGLE_QUOTED" and "\n" not in v and J.NEEDS.search(v.replace('"', "").replace("\\", "")) is None:
            return "'" + v.replace("'", "''") + "'"
        retyped = n.tag is None and resolve(Document(Node("string", v))).root.kind != "string"
        if style in ("DOUBLE_QUOTED", "SINGLE_QUOTED", "LITERAL", "FOLDED") or retyped or not _plain_ok(v):
            return _escaped(v)
        return v

    def block(self, v: str, style: str, indent: int) -> str:
        nl, pad = self.o.newline, " " * max(indent, self.o.indent_spaces)
        keep = len(v) - len(v.rstrip("\n"))
        head = ("|" if style == "LITERAL" else ">") + ("+" if keep else "") if not v.startswith(" ") else ("|" if style == "LITERAL" else ">") + str(self.o.indent_spaces) + ("+" if keep else "")
        lines = v[: len(v) - keep].split("\n")
        if style == "FOLDED":
            out: list[str] = []
            for i, line in enumerate(lines):
                if i and line and lines[i - 1] and line[0] not in " \t" and lines[i - 1][0] not in " \t":
                    out.append("")
                out += self.wrapped(line)
            lines = out
        return nl.join([head, *[pad + x if x else "" for x in lines], *[""] * max(0, keep - 1)])

    def wrapped(self, line: str) -> list[str]:
        width = self.o.line_width
        if not width or len(line) <= width or line[:1] in (" ", "\t"):
            return [line]
        out, now = [], ""
        for word in line.split(" "):
            if now and word and not now.endswith(" ") and len(now) + 1 + len(word) > width:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now or out and not word else word
        return [*out, now]

    def flow(self, n: Node) -> str:
        if n.kind == "alias":
            return f"*{n.value}"
        if n.kind == "sequence":
            return self.prefix(n) + "[" + ", ".join(map(self.flow, n.value)) + "]"
        if n.kind in ("omap", "pairs"):
            return self.prefix(n) + "[" + ", ".join(f"{{{self.flow(k)}: {self.flow(v)}}}" for k, v in n.value) + "]"
        if n.kind in ("mapping", "set"):
            return self.prefix(n) + "{" + ", ".join(f"{self.flow(k)}: {self.flow(v)}" for k, v in n.value) + "}"
        return self.prefix(n) + self.scalar(n, 0, True)

    def is_block(self, n: Node) -> bool:
        return isinstance(n.value, list) and bool(n.value) and self.o.flow_style != "FLOW" and (self.o.flow_style == "BLOCK" or n.style != "FLOW")

    def lines(self, n: Node, indent: int) -> list[str]:
        """Lines of a block collection at an indent."""
        pad, out = " " * indent, []
        pairs = [(None, x) for x in n.value] if n.kind == "sequence" else n.value
        for k, v in pairs:
            first = k if k is not None else v
            for c in (first.leading_comment or "").split("\n") if first.leading_comment else []:
                out.append(f"{pad}# {c}")
            if n.kind in ("omap", "pairs"):
                out += self.entry(f"{pad}- {self.flow(k)}:", v, indent + self.o.indent_spaces)
            elif k is None:
                out += self.entry(f"{pad}-", v, indent)
            elif k.kind == "alias" or not isinstance(k.value, list):
                out += self.entry(f"{pad}{self.flow(k)}{' ' if k.kind == 'alias' else ''}:", v, indent)
            else:
                out += [f"{pad}? {self.flow(k)}", *self.entry(f"{pad}:", v, indent)]
        return out

    def entry(self, head: str, v: Node, indent: int) -> list[str]:
        note = f" # {v.inline_comment}" if v.inline_comment else ""
        if self.is_block(v):
            inner, start = self.lines(v, indent + self.o.indent_spaces), f"{head} {self.prefix(v)}".rstrip()
            if head.endswith("-") and start == head and v.kind != "sequence" and self.o.indent_spaces == 2 and not note and not inner[0].lstrip().startswith("#"):
                return [f"{head} {inner[0].lstrip()}", *inner[1:]]
            return [start + note, *inner]
        if v.kind == "alias" or isinstance(v.value, list):
            return [f"{head} {self.flow(v)}{note}"]
        text = self.prefix(v) + self.scalar(v, indent + self.o.indent_spaces, False)
        first, *rest = text.split(self.o.newline)
        return [f"{head} {first}{note}", *rest]

    def document(self, doc: Document) -> str:
        n = doc.root
        if n is None:
            return ""
        if self.is_block(n):
            start = self.prefix(n).strip()
            lines = ([f"# {c}" for c in n.leading_comment.split("\n")] if n.leading_comment else []) + ([f"--- {start}"] if start else []) + self.lines(n, 0)
        elif n.kind == "alias" or isinstance(n.value, list):
            lines = [self.flow(n)]
        else:
            lines = (self.prefix(n) + self.scalar(n, self.o.indent_spaces, False)).split(self.o.newline)
        return self.o.newline.join(lines) + (self.o.newline if self.o.trailing_newline else "")


def write(doc: Document, o: YamlWriteOptions = YamlWriteOptions()) -> str:
    return Writer(o).document(doc)


def write_all(docs: list[Document], o: YamlWriteOptions = YamlWriteOptions()) -> str:
    return "".join(f"---{o.newline}{write(d, o)}{'' if o.trailing_newline else o.newline}" for d in docs)


def encoded(text: str, o: YamlWriteOptions = YamlWriteOptions()) -> bytes:
    return (("﻿" if o.emit_bom else "") + text).encode(o.encoding)


class EventWriter:
    """Builds documents from events and writes them as a stream; misplaced events are E_STATE."""

    def __init__(self, options: YamlWriteOptions = YamlWriteOptions()):
        self.o, self.stack, self.docs, self.open = options, [], [], False

    def _add(self, n: Node) -> None:
        if not self.open:
            raise TextError("E_STATE", "no document is open")
        if self.stack:
            box = self.stack[-1]
            if box.kind == "sequence":
                box.value.append(n)
            elif box.typed is None:
                box.typed = n  # the key that waits for its value
            else:
                box.value.append((box.typed, n))
                box.typed = None
        elif self.docs[-1].root is None:
            self.docs[-1].root = n
            if n.anchor:
                self.docs[-1].anchors[n.anchor] = n
        else:
            raise TextError("E_STATE", "a second root node")

    def event(self, kind: str, value: str | None = None, tag: str | None = None, anchor: str | None = None, style: str | None = None) -> None:
        if kind == "DOCUMENT_START":
            self.docs.append(Document(None, len(self.docs)))
            self.open = True
        elif kind == "DOCUMENT_END":
            if self.stack or not self.open:
                raise TextError("E_STATE", "a collection is open")
            self.open = False
        elif kind in ("SEQUENCE_START", "MAPPING_START"):
            n = Node(kind.split("_")[0].lower(), [], tag, anchor, style or "BLOCK")
            self._add(n)
            self.stack.append(n)
        elif kind in ("SEQUENCE_END", "MAPPING_END"):
            if not self.stack or self.stack[-1].kind != kind.split("_")[0].lower() or self.stack[-1].typed is not None:
                raise TextError("E_STATE", f"{kind} is out of place")
            self.stack.pop()
        elif kind == "SCALAR":
            n = Node("string", value, tag, anchor, style or "PLAIN")
            if n.style == "PLAIN" and tag is None:
                n = resolve(Document(n)).root
            self._add(n)
        elif kind == "ALIAS":
            self._add(Node("alias", value))

    def finish(self) -> str:
        if self.stack or self.open:
            raise TextError("E_INCOMPLETE", "the stream is not complete")
        return write(self.docs[0], self.o) if len(self.docs) == 1 else write_all(self.docs, self.o)


def plain_value(n: Node | None):
    """Python value of a node, for tests and tools; aliases are followed."""
    n = deref(n)
    if n is None or n.kind == "null":
        return None
    if n.kind == "sequence":
        return [plain_value(x) for x in n.value]
    if n.kind in ("omap", "pairs"):
        return [(plain_value(k), plain_value(v)) for k, v in n.value]
    if n.kind == "set":
        return {plain_value(k) for k, _ in n.value}
    if n.kind == "mapping":
        return {(x if not isinstance(x := plain_value(k), (list, dict)) else str(x)): plain_value(v) for k, v in n.value}
    return n.typed if n.kind in ("bool", "int", "float") else n.value


