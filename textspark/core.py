"""Options, limits, errors and result types shared by the three formats."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Callable

ERROR_TYPE = "struct<code:string,message:string,offset:bigint,line:bigint,col:bigint,snippet:string,caret:bigint>"


def result_type(value: str) -> str:
    """Type of every strict function: ok, the value if ok, the error if not."""
    return f"struct<ok:boolean,value:{value},error:{ERROR_TYPE}>"


class TextError(Exception):
    """A status code with a message and, where one is known, a place in the input (byte offset, 1-based line and column)."""

    def __init__(self, code: str, message: str, offset: int | None = None, line: int | None = None, col: int | None = None, snippet: str | None = None, caret: int | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.offset, self.line, self.col, self.snippet, self.caret = code, message, offset, line, col, snippet, caret

    @classmethod
    def at(cls, code: str, message: str, text: str, pos: int, radius: int = 40) -> TextError:
        pos = min(pos, len(text))
        start = text.rfind("\n", 0, pos) + 1
        lo, hi = max(start, pos - radius), min(len(text), pos + radius)
        cut = text.find("\n", pos, hi)
        hi = hi if cut < 0 else cut
        return cls(code, message, len(text[:pos].encode("utf-8", "surrogatepass")), text.count("\n", 0, pos) + 1, pos - start + 1, text[lo:hi], pos - lo)

    def row(self) -> dict[str, Any]:
        return {k: getattr(self, k) for k in ("code", "message", "offset", "line", "col", "snippet", "caret")}


@dataclass(frozen=True)
class JsonParseOptions:
    allow_comments: bool = False
    allow_trailing_commas: bool = False
    allow_nonfinite_numbers: bool = False
    allow_single_quotes: bool = False
    allow_unescaped_controls: bool = False
    allow_leading_bom: bool = True
    validate_utf8: bool = True
    dupkeys: str = "ERROR"  # ERROR, FIRST_WINS, LAST_WINS, COLLECT
    max_depth: int = 256
    max_string_bytes: int = 16 << 20
    max_container_elems: int = 1 << 20
    max_total_bytes: int = 64 << 20
    preserve_number_lexeme: bool = True
    parse_int64: bool = True
    parse_uint64: bool = True
    parse_double: bool = True

    @classmethod
    def jsonc(cls) -> JsonParseOptions:
        return cls(allow_comments=True, allow_trailing_commas=True)


@dataclass(frozen=True)
class JsonWriteOptions:
    pretty: bool = False
    indent_spaces: int = 2
    newline: str = "\n"
    trailing_newline: bool = False
    space_after_colon: bool = False
    space_after_comma: bool = False
    inline_array_threshold: int = -1
    inline_object_threshold: int = -1
    escape_solidus: bool = False
    escape_unicode: bool = False
    escape_all_non_ascii: bool = False
    sort_object_keys: bool = False
    canonical_numbers: bool = False
    allow_nonfinite_numbers: bool = False
    float_format: str = "SHORTEST"  # SHORTEST, FIXED, SCIENTIFIC
    float_precision: int = 6


@dataclass(frozen=True)
class CsvDialect:
    delimiter: str = ","
    quote: str = '"'
    escape: str = "DOUBLED_QUOTE"  # DOUBLED_QUOTE, BACKSLASH, NONE
    newline_in_quotes: bool = True
    accept_lf: bool = True
    accept_crlf: bool = True
    accept_cr: bool = False
    trim_unquoted_fields: bool = False
    allow_space_after_delimiter: bool = False
    allow_unquoted_quotes: bool = False
    allow_unquoted_newlines: bool = False
    allow_comments: bool = False
    comment_prefix: str = "#"
    treat_first_row_as_header: bool = False
    header_dup_mode: str = "FIRST_WINS"  # FIRST_WINS, ERROR, LAST_WINS, COLLECT


@dataclass(frozen=True)
class CsvParseOptions:
    dialect: CsvDialect = field(default_factory=CsvDialect)
    validate_utf8: bool = True
    keep_bom: bool = False
    max_rows: int = 10_000_000
    max_cols: int = 100_000
    max_field_bytes: int = 16 << 20
    max_record_bytes: int = 64 << 20
    max_total_bytes: int = 1 << 30
    enable_context_snippet: bool = True
    context_radius_bytes: int = 40


@dataclass(frozen=True)
class CsvWriteOptions:
    dialect: CsvDialect = field(default_factory=CsvDialect)
    newline: str = "\n"
    quote_all_fields: bool = False
    quote_empty_fields: bool = True
    quote_if_needed: bool = True
    trailing_newline: bool = False
    trim_trailing_empty_fields: bool = False


@dataclass(frozen=True)
class CustomTag:
    """Callables for a tag: from the scalar's text or node, to a JSON value, to text."""

    tag: str
    construct: Callable[[Any], Any] | None = None
    to_json: Callable[[Any], Any] | None = None
    represent: Callable[[Any], str] | None = None


@dataclass(frozen=True)
class YamlParseOptions:
    mode: str = "DEFAULT"  # DEFAULT, CONFIG
    dupkeys: str = "ERROR"  # ERROR, FIRST_WINS, LAST_WINS
    schema: str = "CORE"  # FAILSAFE, JSON, CORE
    max_depth: int = 256
    max_total_bytes: int = 64 << 20
    max_alias_expansion: int = 10_000
    validate_utf8: bool = True
    resolve_tags: bool = True
    retain_comments: bool = False
    yaml_1_1: bool = False
    enable_custom_tags: bool = False
    allow_nonstandard_tags: bool = True
    allow_aliases: bool = True
    allow_merge_keys: bool = True
    allow_complex_keys: bool = True
    require_string_keys: bool = False
    enable_json_fast_path: bool = True
    custom_tags: tuple[CustomTag, ...] = ()
    warnings_as_errors: bool = False

    @classmethod
    def safe(cls) -> YamlParseOptions:
        return cls(max_depth=64, max_total_bytes=16 << 20, max_alias_expansion=1000, allow_nonstandard_tags=False, allow_aliases=False, allow_merge_keys=False, allow_complex_keys=False, require_string_keys=True)

    def effective(self) -> YamlParseOptions:
        if self.mode != "CONFIG":
            return self
        return replace(self, schema="FAILSAFE", allow_complex_keys=False, require_string_keys=True, enable_json_fast_path=False)


@dataclass(frozen=True)
class YamlWriteOptions:
    pretty: bool = False
    indent_spaces: int = 2
    line_width: int = 0
    newline: str = "\n"
    trailing_newline: bool = False
    canonical: bool = False
    scalar_style: str = "PLAIN"  # PLAIN, SINGLE_QUOTED, DOUBLE_QUOTED, LITERAL, FOLDED
    flow_style: str = "AUTO"  # AUTO, BLOCK, FLOW
    encoding: str = "utf-8"
    emit_bom: bool = False
    custom_tags: tuple[CustomTag, ...] = ()


@dataclass(frozen=True)
class YamlToJsonOptions:
    allow_resolved_aliases: bool = False
    allow_merge_keys: bool = False
    coerce_keys_to_strings: bool = False
    large_int_policy: str = "ERROR"  # ERROR, STRING, DOUBLE
    custom_tags: tuple[CustomTag, ...] = ()
