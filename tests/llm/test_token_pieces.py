"""Pieces of words in op10's encoder: the library's ids, each piece coded once."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismora.llm import token_files
from prismora.llm.tokens import default_path, json_encoder

ODD = ["a", "B", "J", "j", "'", "'s", "'LL", ".", ",", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "7", "42", "\x00", "\x1c", "\x85", "\xa0", " ", "\n", "̈", "̌", "̸", "ß", "É", "İ", "Σ", "。", "각", "½", "\U0001f600"]


def test_a_piece_is_coded_once():
    """Case and punctuation beside a word give no further words to code."""
    encoder = token_files.WordEncoder(default_path("word_bpe_49k.json"))
    texts = ["Zebraword zebraword, ZEBRAWORD. (zebraword)", "zebraword... zebraWord!"]
    given = []
    coded = encoder._coded
    encoder._coded = lambda body, ends: (given.append((body, len(ends))), coded(body, ends))[1]
    ids, counts = encoder.batch(pa.array(texts))
    want = [json_encoder(default_path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))
    assert [n for _, n in given] == [7] and given[0][0].count(b"zebraword") == 1  # , . ( ) ... !
    encoder.batch(pa.array(texts))
    assert len(given) == 1


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=25).map("".join), min_size=1, max_size=8), st.sampled_from([4, 100_000]))
def test_ids_are_the_librarys(texts, memo):
    encoder, library = token_files.WordEncoder(default_path("word_bpe_49k.json"), memo), json_encoder(default_path("word_bpe_49k.json"))
    for part in (texts, texts[::-1]):
        ids, counts = encoder.batch(pa.array(part, pa.string()))
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


@pytest.mark.parametrize("top", [1, 300, 65_536, 1 << 20])
def test_blocks_packed_together_are_the_same(top):
    ids = np.random.default_rng(top).integers(0, top, (5, token_files.BLOCK)).astype(np.uint32)
    assert list(token_files.pack_blocks(ids)) == [token_files.pack_block(x) for x in ids]
