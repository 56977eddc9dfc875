"""The chunked, cached encoder gives the tokenizer's own ids, whatever the text."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faresight.llm import packing

ENC = packing.Encoder(packing.tokenizer_path(), packing.ranks_path())
PLAIN = packing.Encoder(packing.tokenizer_path())
BITS = st.sampled_from([" ", "  ", "\n", "\t", " \n", "a", "it's", "We'LL", "é", "ß12", "ñ", "<|endoftext|>", "x" * 40, "12,5", "…", "中文", " ",
                        "\u0085", "🙂", "-", "'s", "ẞ", "\x1c", ""])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(BITS, max_size=12).map("".join), st.text(max_size=30)), min_size=1, max_size=5))
def test_same_ids(texts):
    want = [e.ids for e in ENC.tk.encode_batch(texts, add_special_tokens=False)]
    for enc in (ENC, PLAIN):
        assert [x.tolist() for x in enc.batch(pa.array(texts, pa.string()))] == want


def test_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 2)
    for t in ("one two three four", "two three five"):
        assert np.array_equal(ENC.batch(pa.array([t]))[0], ENC.whole(t))
