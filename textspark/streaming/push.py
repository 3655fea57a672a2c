"""Push and pull parsers over chunks of one text on the driver or in a UDF.

Any cut of a text gives the same events. CSV records are given out as soon as
they are complete; JSON and YAML need their whole text for its errors to be
the same, so they hold it, up to the format's byte limit.
"""

from __future__ import annotations

import codecs
from collections import deque
from typing import Any, Callable, Iterator

from ..core import CsvParseOptions, JsonParseOptions, TextError, YamlParseOptions
from ..functions import csv_model as C
from ..functions import json_model as J
from ..functions import yaml_model as Y

OPTIONS = {"json": JsonParseOptions, "csv": CsvParseOptions, "yaml": YamlParseOptions}


class PushParser:
    """``feed`` text or UTF-8 bytes, then ``finish``; events go to the callback, or to ``events`` without one."""

    def __init__(self, kind: str, callback: Callable[..., Any] | None = None, options=None):
        self.kind, self.options, self.events = kind, options or OPTIONS[kind](), deque()
        self.callback = callback or (lambda *e: self.events.append(e))
        self.decoder, self.parts, self.size, self.rows, self.done = codecs.getincrementaldecoder("utf-8")(), [], 0, 0, False

    def feed(self, chunk: str | bytes) -> None:
        if self.done:
            raise TextError("E_STATE", "the parser is finished")
        try:
            text = chunk if isinstance(chunk, str) else self.decoder.decode(chunk)
        except UnicodeDecodeError as e:
            raise TextError("E_INVALID", "not UTF-8", e.start) from e
        self.size += len(text.encode("utf-8", "surrogatepass"))
        if self.size > self.options.max_total_bytes:
            raise TextError("E_LIMIT", "input is too long")
        self.parts.append(text)
        if self.kind == "csv":
            self._records()

    def _records(self) -> None:
        """Gives out the records before the last line break that is outside quotes."""
        d, text = self.options.dialect, "".join(self.parts)
        if d.escape != "DOUBLED_QUOTE" or d.allow_unquoted_quotes or d.allow_comments or not d.quote:
            return  # counting quotes cannot tell where a record ends
        cut = text.rfind("\n")
        if cut < 0 or text.count(d.quote, 0, cut) % 2:
            return
        self._csv(text[: cut + 1])
        self.parts = [text[cut + 1 :]]

    def _csv(self, text: str) -> None:
        for row in C.records(text, self.options):
            self.callback("RECORD_BEGIN", self.rows, None, None)
            for j, f in enumerate(row):
                self.callback("FIELD", self.rows, j, f)
            self.callback("RECORD_END", self.rows, None, None)
            self.rows += 1

    def finish(self) -> None:
        if self.done:
            raise TextError("E_STATE", "the parser is finished")
        self.done = True
        try:
            text = "".join(self.parts) + self.decoder.decode(b"", True)
        except UnicodeDecodeError as e:
            raise TextError("E_INCOMPLETE", "the text ends inside a character", e.start) from e
        if self.kind == "csv":
            self._csv(text)
            self.callback("END", self.rows, None, None)
        else:
            for e in (J if self.kind == "json" else Y).events(text, self.options):
                self.callback(*e)


class PullReader:
    """``feed`` chunks (None ends the input), then ``next`` gives one event at a time; E_INCOMPLETE while input is missing."""

    def __init__(self, kind: str = "yaml", options=None):
        self.parser = PushParser(kind, None, options)

    def feed(self, chunk: str | bytes | None) -> None:
        if chunk is None:
            self.parser.finish()
        else:
            self.parser.feed(chunk)

    def next(self) -> tuple:
        if self.parser.events:
            return self.parser.events.popleft()
        raise TextError("E_STATE" if self.parser.done else "E_INCOMPLETE", "no event")

    def __iter__(self) -> Iterator[tuple]:
        while self.parser.events:
            yield self.parser.events.popleft()
