import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.words import grouped_words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abC \n\té\x0b\x1c", max_size=30)), max_size=20))
def test_hashes_stand_for_words(texts):
    seen: dict[bytes, int] = {}
    for lo, h, first in grouped_words(pa.array(texts, pa.string())):
        for k in range(len(first) - 1):
            words = (texts[lo + k] or "").encode().lower().split()
            own = h[first[k] : first[k + 1]].tolist()
            assert len(words) == len(own)
            assert all(seen.setdefault(w, x) == x for w, x in zip(words, own))
    assert len(set(seen.values())) == len(seen)
