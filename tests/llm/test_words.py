import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.common import grams, member, sieve, words

RULE = regex.compile("[0-9A-Za-z_À-῿Ⰰ-⿿぀-\U0010ffff]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_words_follow_the_rule(texts):
    texts = [None if t is None else "".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts]
    w = words(pa.array(texts, pa.string()), lower=False)
    want = [RULE.findall(t or "") for t in texts]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)] == [x for t in want for x in t]
    assert np.diff(w.ptr).tolist() == [len(t) for t in want]
    flat = [x for t in want for x in t]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (a == b) == (w.hashes[i] == w.hashes[j])


def test_member_and_grams():
    rng = np.random.default_rng(0)
    table = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    probe = np.concatenate([table, rng.integers(0, 2**63, 50, dtype=np.uint64)])
    assert (member(probe, table, sieve(table))[:50] == np.arange(50)).all() and (member(probe, table, sieve(table))[50:] == -1).all()
    assert len(grams(table, 60)) == 0 and grams(table[:4], 2)[1] == grams(table[1:3], 2)[0]
