import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import textarrays as ta

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ09 .,\n\té\x85 😀-", max_size=40)), max_size=12)
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_regex(texts):
    for pattern, table in ((r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ta.ALNUM), (r"[^\x20\x09-\x0D]+", ta.NONBLANK)):
        want = [re.findall(pattern, lower(t or "")) for t in texts]
        seen, at = {}, 0
        for a, b, data, bounds in ta.text_blocks(pa.array(texts, pa.string())):
            assert a == at
            at = b
            h, starts, ends, first = ta.words(data, bounds, table)
            for k in range(b - a):
                lo, hi = first[k], first[k + 1]
                got = [bytes(data[s:e]).decode() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                assert [lower(g) for g in got] == want[a + k]
                for w, x in zip(want[a + k], h[lo:hi].tolist(), strict=True):
                    assert seen.setdefault(w, x) == x
        assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_blocks_split_and_slices():
    texts = ["x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000, "w"]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    got = [(a, b, bytes(data), bounds.tolist()) for a, b, data, bounds in ta.text_blocks(column)]
    assert b"".join(g[2] for g in got).decode() == "".join(t or "" for t in texts) and len(got) >= 4
    assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]] and got[-1][1] == len(texts)
    assert list(ta.text_blocks(pa.array([], pa.string()))) == []


def test_spread_and_mixed():
    assert ta.spread(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(ta.mixed(x))) == len(x)
