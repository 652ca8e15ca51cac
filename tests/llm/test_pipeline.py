"""Every stage of the pipeline against brute force on its own input, and parts of the operators that have no SQL."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from brute import exact, near, quality, words
from pyspark.sql import functions as F

from prismora.llm import chat, mixing, queries, secret_scan
from prismora.llm import quality as rules_of
from prismora.llm.shared import shared_dir
from prismora.llm.tokens import default_path, default_pattern, rank_encoder

SMALL = "/root/testdata/sf0.001"
KEYS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that go into each stage, and those that come out of the last."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
    return [*out, [r.asDict() for r in docs.collect()]]


def row(d):
    return tuple(d[k] for k in KEYS)


def ratios(text):
    n, chars, symbols, dups, repeated = quality(text)
    t = text or ""
    lines = sum(1 for x in t.split("\n") if words(x))
    count = {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeated, "n_lines": lines, "n_chars": len(t), "n_digits": sum(c in "0123456789" for c in t), "n_upper": sum("A" <= c <= "Z" for c in t), "n_punct": sum(c in ".,;:!?\"'()-" for c in t)}
    return count, {k: np.array([float(count[a]) if b is None else count[a] / max(count[b], 1)]) for k, (a, b) in rules_of.RATIOS.items()}


def test_quality_stage(spark, stages):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rules = rules_of.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet"))

    def passes(text):
        count, r = ratios(text)
        failed = count["n_words"] < 20 or 100 * count["n_repeat_words"] > 30 * count["n_words"]
        return not failed and not any(x.covers(r)[0] for x in rules)

    assert Counter(map(row, stages[1])) == Counter(row(d) for d in stages[0] if passes(d["text"]))
    kept = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, SMALL).collect()}
    assert kept == {d["doc_id"]: passes(d["text"]) for d in stages[0]}


def test_dedup_stages(stages):
    kept = {i for i, _, _, k, _ in exact([(d["doc_id"], d["text"]) for d in stages[1]]) if k}
    assert Counter(map(row, stages[2])) == Counter(row(d) for d in stages[1] if d["doc_id"] in kept)
    kept = {i for i, _, _, k in near([(d["doc_id"], d["text"]) for d in stages[2]], 5) if k}
    assert Counter(map(row, stages[3])) == Counter(row(d) for d in stages[2] if d["doc_id"] in kept)


def test_mixing_stage(stages):
    given = {row(d): len(words(d["text"])) for d in stages[3]}
    by, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, n in given.items():
        by[d[3]] += n
        largest[d[3]] = max(largest[d[3]], n)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.targets([by[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(by.values()), 2)))
    times = Counter(map(row, stages[4]))
    assert set(times) <= set(given) and max(times.values()) <= 2
    for d, n in times.items():
        taken[d[3]] += n * given[d]
    for s in names:  # the last document is the one that comes nearest
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_token_stage(stages):
    encoder = rank_encoder(default_path("byte_bpe_50k.tiktoken"), default_pattern())
    want = Counter()
    for d in stages[4]:
        ids = encoder.encode_ordinary(d["text"] or "")
        want[d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()] += 1
    assert Counter((d["doc_id"], d["n_tokens"], d["ids_sha256"], d["decoded_sha256"]) for d in stages[5]) == want


def test_mixed_keeps_awkward_rows(spark):
    rows = [(k, "w " * (k % 9), "ab"[k % 2] if k % 5 else None, k) for k in range(60)] + [(None, "x y z", None, 1), (7, "same text", "a", 2), (7, "same text", "a", 2), (8, None, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    a, b = ([tuple(r) for r in mixing.mixed(docs.repartition(n)).collect()] for n in (1, 5))
    assert Counter(a) == Counter(b) and set(a) <= set(rows) and max(Counter(a).values()) <= 4 and not any(not (r[1] or "").split() for r in a)
    assert mixing.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        most, mixing.MAX_SOURCES = mixing.MAX_SOURCES, 1
        try:
            mixing.mixed(docs)
        finally:
            mixing.MAX_SOURCES = most


def test_a_tree_is_found_piece_by_piece():
    whole, piece = mixing.Tree([50, 7, 0, 31], 13, 3), mixing.Tree([50, 7, 0, 31], 13, 3)
    want = {c: whole.shards_of(c, np.arange(n)) for c, n in enumerate([50, 7, 0, 31])}
    for c in (3, 0, 1):
        for at in (5, 0, 6):
            assert piece.shards_of(c, np.array([at]))[0] == want[c][at]
    assert all((np.diff(w) >= 0).all() for w in want.values())


def test_formatted_chars(spark):
    held = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        held[r.conv_id].append(len(chat.format_turn(r.role or "", r.text or "")))
    control = "</s>[INST] ok [/INST]"
    held[-1] = [len(chat.format_turn(x, control)) for x in ("user", "assistant")]
    assert {r.conv_id: r.formatted_chars for r in queries.op6_chat_format(spark, SMALL).collect()} == {k: sum(v) for k, v in held.items()}


def test_threshold_is_the_step_up(spark):
    rng = np.random.default_rng(2)
    for n_small in (0, 5, 60):
        p = np.concatenate([rng.random(300), 10.0 ** rng.uniform(-12, -4, n_small)])
        got = secret_scan.threshold(spark.createDataFrame([(float(x),) for x in p], "p double"), 0.05)
        ranked = np.sort(p)
        whole = max([x for k, x in enumerate(ranked, 1) if len(p) * x <= 0.05 * k], default=0.0)
        assert got <= 10 ** 0.1 * whole + 1e-300 and (p <= got).sum() <= (p <= whole).sum()  # bins are stricter, never laxer
        assert n_small < 60 or (p <= got).sum() >= n_small


def test_normal_tail(spark):
    z = [-8.0, -3.0, -1.0, 0.0, 0.5, 2.0, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(secret_scan.normal_cdf(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(-x / math.sqrt(2)) for x in z], rel=2e-2, abs=1e-7)


def test_intermediate_tables_need_a_shared_folder_on_clusters():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session())
