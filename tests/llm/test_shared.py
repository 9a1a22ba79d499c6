import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm.shared import ALNUM, NOT_SPACE, Words, covered, slices, window_hash

TEXT = st.text(alphabet="ab Z9\t\n\x0b\x1f.é漢 ", max_size=40)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for kind, pattern, low in ((NOT_SPACE, r"[^\x20\x09-\x0D]+", False), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True)):
        got = []
        for _, _, data, offsets in slices(pa.array(texts, pa.string()), 16):
            w = Words(data, offsets, kind, lower=low)
            for d in range(len(offsets) - 1):
                got.append([bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]])])
        assert got == [re.findall(pattern, lower(t or "") if low else t or "") for t in texts]


def test_equal_words_and_windows_have_equal_hashes_wherever_they_stand():
    data = np.frombuffer(b"one two three x one two three", np.uint8)
    w = Words(data, np.array([0, len(data)]), NOT_SPACE)
    h = w.hashes()
    assert (h[:3] == h[4:]).all() and len(set(h.tolist())) == 4
    windows = window_hash(h, 3)
    assert windows[0] == windows[4] and len(set(windows.tolist())) == 4
    assert covered(np.array([0, 4]), 3, 7).tolist() == [True] * 3 + [False] + [True] * 3
