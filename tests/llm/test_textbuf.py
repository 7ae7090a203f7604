import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm.textbuf import shingles, slices, utf8, word_spans

TEXT = st.text(alphabet="aAbBéß \t\n\x0b  .,", max_size=60)


def expected(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=6), st.integers(1, 5))
def test_shingle_sets_agree(texts, width):
    got, want = list(shingles(pa.array(texts, pa.string()), width)), [expected(t, width) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_long_rows_come_alone_and_sliced_columns_work():
    column = pa.array(["a b c d e f", "x" * 50, "", None, "p q"], pa.string()).slice(1)
    buf, off = utf8(column)
    assert off[-1] - off[0] == 53 and list(slices(off, 10)) == [(0, 1), (1, 4)]
    part, rows = buf[off[0] : off[-1]], off - off[0]
    starts, ends, row = word_spans(part, rows)
    assert row.tolist() == [0, 3, 3] and (ends - starts).tolist() == [50, 1, 1]
