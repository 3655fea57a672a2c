"""Push and pull parsers: any cut of the bytes gives the events of the whole."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textspark.core import TextError
from textspark.functions import csv_model as C
from textspark.functions import json_model as J
from textspark.functions import yaml_model as Y
from textspark.streaming.push import PullReader, PushParser

TEXTS = {"json": ('{"a":[1,2.5,"é😀\\n"],"b":{}}', J), "csv": ('a,"b ""q"" é"\n1,"x\ny"\n\n2,\n', C), "yaml": ("a: é\nb:\n- x\n- |\n  l\n  m\n", Y)}


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(list(TEXTS)), st.lists(st.integers(0, 60), max_size=8))
def test_any_cut(kind, cuts):
    text, model = TEXTS[kind]
    data, out = text.encode(), []
    p = PushParser(kind, lambda *e: out.append(e))
    edges = sorted({0, len(data), *[c for c in cuts if c < len(data)]})
    for a, b in zip(edges, edges[1:], strict=False):
        p.feed(data[a:b])
    p.finish()
    assert out == [tuple(e) for e in model.events(text)]


def test_states():
    r = PullReader("yaml")
    r.feed("a: 1")
    with pytest.raises(TextError) as e:
        r.next()
    assert e.value.code == "E_INCOMPLETE"
    r.feed(None)
    assert r.next()[0] == "STREAM_START" and [e[0] for e in r][-1] == "STREAM_END"
    with pytest.raises(TextError) as e:
        r.next()
    assert e.value.code == "E_STATE"
    for chunk, code in ((b"\xff", "E_INVALID"), (b'"\xc3', "E_INCOMPLETE")):
        p = PushParser("json")
        with pytest.raises(TextError) as e:
            p.feed(chunk)
            p.finish()
        assert e.value.code == code
