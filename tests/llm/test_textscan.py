import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wirefold.llm import textscan as ts

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBc \n\té1_-\U0001F600", max_size=12)), max_size=8)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_words_equal_expressions(texts):
    data, offsets = ts.text_buffer(pa.array(texts, pa.string()))
    for table, pattern in ((ts.SPACES, r"[^\x20\x09-\x0D]+"), (ts.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        start, end, h, first = ts.words(data, offsets, table)
        seen = {}
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").translate(LOWER))
            a, z = first[i], first[i + 1]
            got = [data[s:e].tobytes().decode().translate(LOWER) for s, e in zip(start[a:z], end[a:z])]
            assert got == want
            for w, x in zip(want, h[a:z].tolist()):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_batch():
    texts = ["x " * 50_000, "", None, "abc", "", "def", "y" * 3_000_000, "abc def"]
    data, offsets = ts.text_buffer(pa.array(texts, pa.string()))
    _, _, h, first = ts.words(data, offsets, ts.SPACES)
    for i, t in enumerate(texts):
        d, o = ts.text_buffer(pa.array([t], pa.string()))
        assert np.array_equal(ts.words(d, o, ts.SPACES)[2], h[first[i]:first[i + 1]])
    sliced = pa.array(texts, pa.string()).slice(3, 3)
    d, o = ts.text_buffer(sliced)
    assert len(ts.words(d, o, ts.SPACES)[2]) == 2
