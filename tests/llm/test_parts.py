"""Parts of the operators: filters, components, packing, splitting, rules, links of dense groups."""

import io

import numpy as np
import pyarrow as pa
import pytest
from brute import near
from hypothesis import given, settings
from hypothesis import strategies as st

from prismora.llm import bpe, chat, fuse_filter, mixing, near_dedup, quality, token_counts, token_files
from prismora.llm.components import components
from prismora.llm.tokens import default_path, default_pattern, rank_encoder


@pytest.mark.parametrize("n", [0, 1, 2, 10, 1000, 50_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    f = fuse_filter.build(keys)
    assert f.contains(keys).all()
    others = np.random.default_rng(n + 1).integers(0, 1 << 64, 100_000, dtype=np.uint64)
    assert f.contains(others).mean() < 0.006
    assert n < 1000 or 8 * len(f.slots) / n < 14


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (300, 300), (None, 1)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def test_dense_groups_near_the_threshold(spark):
    """Edited copies whose mutual similarity is on both sides of 0.8."""
    rng = np.random.default_rng(3)
    base = [f"word{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for k in range(150):
        text = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            text[at] = f"new{rng.integers(10_000)}"
        rows.append((k, " ".join(text)))
    found = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, found.select("doc_id", "n_shingles", "component_id", "kept").collect())) == near(rows, 5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=token_files.BLOCK), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
def test_block_round_trip(ids, share):
    ids = np.array(ids, np.uint32)
    assert np.array_equal(token_files.unpack_block(b"xx" + token_files.pack_block(ids, share), 2), ids)


def test_file_reads_any_document():
    rng, out = np.random.default_rng(5), io.BytesIO()
    texts = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (0, 1, 5000, 0, 1024, 7)]
    w = token_files.Writer(out)
    for k, t in enumerate(texts):
        w.add([k], np.array([len(t)]), t)
    w.close()
    r = token_files.Reader(out.getvalue())
    assert all(np.array_equal(r.document(k), t) for k, t in enumerate(texts))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<s>/[INT]\\ab"))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    assert chat.parse_turn(chat.format_turn("a" + text, text)) == ("a" + text, text)


def test_prefix_tree_shares_turns(spark):
    turns = [(c, t, "user", f"{t if t < 3 else c}") for c in range(5) for t in range(5)]
    nodes, paths = chat.prefix_tree(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = sorted(nodes.collect(), key=lambda r: r.start)
    assert len(got) == 3 + 5 * 2 and paths.count() == 25
    at = {r.key: r for r in got}
    place = 0
    for r in got:
        assert r.start == place  # each once, without gaps
        place += r.chars
        inside = sum(x.end - x.start for x in r.attends)
        assert r.position == inside
        if r.parent in at:
            p = at[r.parent]
            assert p.start < r.start and any(x.start <= p.start and p.start + p.chars <= x.end for x in r.attends)


@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_quotas_split_exactly(quotas, shards):
    out = mixing.split_quotas(quotas, shards, 1)
    assert (out >= 0).all() and out.sum(axis=0).tolist() == quotas
    assert out.sum(axis=1).max() - out.sum(axis=1).min() <= 2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_permutation_is_one(n):
    x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
    assert sorted(x) == list(range(n))


def test_targets():
    assert mixing.targets([100, 100, 100], [3, 1, 2], 450, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([], [], 0, 2) == []


def test_decision_list_finds_a_planted_rule():
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    rules = quality.learn(x, bad)
    hit = np.any([r.covers(x) for r in rules], axis=0)
    assert rules and (hit == bad).mean() > 0.97


def test_boundary_rules():
    ends, bounds = np.array([2, 7, 9]), np.array([0, 3, 8])  # tokens 0-2, 2-7, 7-9
    assert token_counts.attribute(ends, bounds, "first")[0].tolist() == [2, 1, 0]
    assert token_counts.attribute(ends, bounds, "last")[0].tolist() == [1, 1, 1]
    n, crossing = token_counts.attribute(ends, bounds, "most")
    assert n.tolist() == [1, 2, 0] and crossing.tolist() == [1, 1, 0]


def test_field_counts(spark):
    rows = spark.createDataFrame([(1, "ab", None, "c d e")], "doc_id long, lang string, source string, text string")
    got = token_counts.field_counts(rows, ["lang", "source", "text"]).collect()
    assert [(r.section, r.start, r.end) for r in got] == [(0, 0, 3), (1, 3, 4), (2, 4, 9)]


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_the_library(text):
    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    parts = next(bpe.coder(path, pattern).batch([text]))
    ids = [int(x) for p in parts for x in p[0].split()]
    assert ids == rank_encoder(path, pattern).encode_ordinary(text)
    assert b"".join(p[1] for p in parts) == text.encode()


@pytest.mark.parametrize("word", ["a" * 500, "=-" * 100, "ab" * 200, "日本語" * 60])
def test_long_pieces(word):
    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    coder = bpe.coder(path, pattern)
    assert bpe._contract(word[:20].encode()[:60], coder.table) == coder.encode_words([word[:20].encode()[:60]])[0]
    assert coder.encode_words([word.encode()])[0] == rank_encoder(path, pattern).encode_ordinary(word)


@pytest.mark.parametrize(("size", "length"), [(1_000_000, 60), (2_000_000, 60), (2_000_000, 30), (2_000_000, 12)])
def test_texts_of_long_words(size, length):
    """Random words of one length: every piece is new and takes as many steps as it can."""
    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    letters = np.random.default_rng(length).integers(97, 123, size).astype(np.uint8).tobytes().decode()
    text = " ".join(letters[k : k + length] for k in range(0, size, length))
    parts = next(bpe.coder(path, pattern).batch([text]))
    assert [int(x) for p in parts for x in p[0].split()] == rank_encoder(path, pattern).encode_ordinary(text)
    assert b"".join(p[1] for p in parts) == text.encode()


def test_one_very_long_piece():
    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    text = np.random.default_rng(0).integers(97, 123, 100_000).astype(np.uint8).tobytes().decode()
    parts = next(bpe.coder(path, pattern).batch([text]))
    assert len(parts) == 1 and [int(x) for x in parts[0][0].split()] == rank_encoder(path, pattern).encode_ordinary(text)


def test_stretches_are_the_text(monkeypatch):
    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    texts = ["", "a b c d e f", "one", "", "x " * 9, "a b c"]
    monkeypatch.setattr(bpe, "STRETCH", 3)
    want = [rank_encoder(path, pattern).encode_ordinary(t) for t in texts]
    assert [[int(x) for p in parts for x in p[0].split()] for parts in bpe.coder(path, pattern).batch(texts)] == want


def test_mix_is_written_block_by_block(spark):
    rows = [(k, " \n" * (k % 3) + "\t ".join(f"d{k}w{j}é" for j in range(k % 300)), "ab"[k % 2]) for k in range(120)] + [(None, "x y z", None), (5, None, "a"), (7, "same text", "a"), (7, "same text", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix, placed, _ = mixing.write_mix(docs, shards=3)
    at = {(r.source, r.start): r for r in placed.where("blocks > 0").collect()}
    text = {(i, s): (t or "").split() for i, t, s in rows[:120]}
    parts = mix.collect()
    assert {r.shard for r in parts} == {0, 1, 2}
    for r in parts:
        d = at[r.source, r.start]
        assert d.doc_id == r.doc_id and len(r.text.split()) == min(64, d["size"] - 64 * r.block)
        if (r.doc_id, r.source) in text and r.doc_id != 7:
            assert r.text.split() == text[r.doc_id, r.source][64 * r.block : 64 * r.block + 64]
    for shard in range(3):  # files hold their rows in the order of the shard
        slots = [r.slot for r in parts if r.shard == shard]
        assert slots == sorted(slots) and len(slots) > 1
    sums = {}
    for r in parts:
        sums[r.doc_id] = sums.get(r.doc_id, 0) + len(r.text.split())
    for r in mixing.mix_sizes(docs, shards=3).groupBy("doc_id").sum("taken").collect():
        assert r[1] == sums.get(r.doc_id, 0)


def test_quality_tasks_free_the_coder_of_their_worker():
    """Workers are used again, so what one operator holds there would add to the next one's memory."""
    from prismora.llm import text

    path, pattern = default_path("byte_bpe_50k.tiktoken"), default_pattern()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b a", None]})
    coded = [x for b in text.lean(bpe._digests(path, pattern), "bpe")(iter([batch])) for x in b.column(1).to_pylist()]
    assert coded == [len(rank_encoder(path, pattern).encode_ordinary("a b a")), 0] and len(bpe._coders) == 1
    counted = [x for b in text.lean(quality._counted)(iter([batch])) for x in b.column(1).to_pylist()]
    assert counted == [3, 0] and not bpe._coders


def test_bodies_that_are_not_the_pieces_own():
    assert bpe._joined([("1 2", b"x"), "3"], ["ab", "c"]) == ("1 2 3", b"xc") and bpe._joined(["1 2", "3"], ["\u00e9", "c"]) == ("1 2 3", "\u00e9c".encode())
