"""Documents that arrive in chunks, in any cut and any order.

Input rows are (doc_id, chunk_no, text, is_last). The state of a document is
its chunks that are not yet complete; when all from 0 to the last are there,
they are joined in order, parsed, and one result row is given out. Any cut of
a text gives the same result, as the parser sees the whole text. A timeout by
processing time drops documents that are never finished.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..core import TextError
from ..functions import csv_model as C
from ..functions import json_model as J
from ..functions import yaml_model as Y
from ..functions.json import strict

RESULT = "doc_id string, ok boolean, value string, code string"
STATE = "chunks array<string>, numbers array<int>, last int"


def _json(text: str) -> str:
    return J.write(J.parse(text))


def _csv(text: str) -> str:
    return J.write([list(r) for r in C.records(text)])


def _yaml(text: str) -> str:
    return J.write(Y.to_json(Y.parse(text)))


PARSERS = {"json": _json, "csv": _csv, "yaml": _yaml}


def parsed(kind: str, text: str) -> tuple[bool, str | None, str | None]:
    try:
        return True, PARSERS[kind](text), None
    except TextError as e:
        return False, None, e.code


def parse_chunks(chunks: DataFrame, kind: str = "json", timeout: str | None = "1 hour") -> DataFrame:
    """A stream of results from a stream of chunks. Without a timeout unfinished documents are kept; bounded runs (availableNow) need that to end."""
    milliseconds = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else 0

    def step(key, frames, state):
        (doc,) = key
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"doc_id": [doc], "ok": [False], "value": [None], "code": ["E_INCOMPLETE"]})
            return
        texts, numbers, last = state.get if state.exists else ([], [], -1)
        have = dict(zip(numbers, texts, strict=True))
        for f in frames:
            for n, text, is_last in zip(f.chunk_no, f.text, f.is_last, strict=True):
                have.setdefault(int(n), text)
                last = int(n) if is_last else last
        if last >= 0 and len(have) == last + 1:
            if state.exists:
                state.remove()
            ok, value, code = parsed(kind, "".join(have[i] for i in range(last + 1)))
            yield pd.DataFrame({"doc_id": [doc], "ok": [ok], "value": [value], "code": [code]})
        else:
            state.update((list(have.values()), list(have), last))
            if milliseconds:
                state.setTimeoutDuration(milliseconds)

    rows = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_no").cast("int").alias("chunk_no"), "text", "is_last")
    return rows.groupBy("doc_id").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if milliseconds else GroupStateTimeout.NoTimeout)


def parse_chunks_batch(chunks: DataFrame, kind: str = "json") -> DataFrame:
    """The same on a batch: chunks are ordered and joined in the JVM, then parsed."""
    whole = chunks.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda x: x["text"]), "").alias("text"),
        (F.count("*") == F.max(F.when(F.col("is_last"), F.col("chunk_no") + 1))).alias("whole"),
    )
    result = strict("string", PARSERS[kind], F.when(F.coalesce("whole", F.lit(False)), F.col("text")))
    return whole.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(result["ok"], F.lit(False)).alias("ok"), result["value"].alias("value"), F.coalesce(result["error"]["code"], F.when(result.isNull(), F.lit("E_INCOMPLETE"))).alias("code"))
