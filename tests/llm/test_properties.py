import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxloom.llm import encode as E
from voxloom.llm import packing as P
from voxloom.llm.lookalike import plain_form
from voxloom.llm.tokenizers import TOKENIZER_DIR, encoding

TEXT = st.text(st.one_of(st.sampled_from(list("a\u0430\u043e\u03bf\u0455\u0301\u0307\u200b\u200d\u00a0\uff45\ufb01\u2177\U0001f469\U0001f680'\u2019 \n1\u00b2\u017c")), st.characters(exclude_categories=["Cs"])), max_size=60)
# the table of look-alike letters is read through a session
pytestmark = pytest.mark.usefixtures("spark")


@given(TEXT)
@settings(max_examples=2000, deadline=None)
def test_plain_form_is_idempotent(text):
    once = plain_form(text)
    assert plain_form(once) == once


@pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no tokenizers here")
@given(TEXT, st.integers(1, 30))
@settings(max_examples=1000, deadline=None)
def test_tree_equals_the_whole(text, leaf):
    encode = E._encoder("byte_bpe_50k", TOKENIZER_DIR)
    assert E.encode_tree(text, encode, leaf).tolist() == encoding().encode_ordinary(text)


@given(st.lists(st.floats(0.001, 10), max_size=60))
@settings(max_examples=300, deadline=None)
def test_bins_hold_their_items(lengths):
    bins, fill, size = P.pack(np.array(lengths), 10.0)
    assert len(bins) == len(lengths) and all(f <= s * (1 + 1e-9) <= 10.00001 for f, s in zip(fill, size))
    assert sorted(set(bins.tolist())) == list(range(len(fill)))
    assert len(fill) <= 2 * sum(lengths) / 10 + 1
