"""Random strings of every encoding planted among ordinary identifiers."""

import zlib

import numpy as np
import pytest

from prismora.llm import secret_scan
from prismora.llm.ordinary import ALPHABETS

WORDS = (
    "account balance customer invoice payment address shipping number total amount currency discount product category price status order created updated deleted user session request response "
    "handler manager factory controller service client server buffer stream reader writer parser result error message default config value index table column schema query cache thread worker"
).split()  # not the text the null was measured on
#: Least share found, where a third of the candidates are planted; short strings of some encodings are near ordinary text.
LEAST = {20: {"decimal": 0.2, "letters": 0.5, "hex": 0.75, "base32": 0.5, "base62": 0.6, "base64": 0.75, "base64url": 0.7}, 32: {}, 64: {}}


def identifier(rng):
    words = [str(w) for w in rng.choice(WORDS, 4)]
    figure = str(rng.integers(1, 3000))
    styles = ("".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]) + figure, "_".join(words), "-".join([*words, figure]), "/".join(words), "_".join(words).upper(), words[0] + figure + words[1] + words[2])
    return styles[rng.integers(len(styles))]


@pytest.mark.parametrize("n", [20, 32, 64])
def test_random_strings_are_found_among_ordinary_identifiers(spark, n):
    rng = np.random.default_rng(n)
    rows, planted = [], {}
    for e, alphabet in ALPHABETS.items():
        if e in ("hex", "decimal") and n >= 32:
            continue  # the base pattern's
        for k in range(60):
            i = len(rows)
            rows.append((i, "see " + "".join(rng.choice(list(alphabet), n))))
            planted[i] = e
    plain = [(len(rows) + k, "see " + identifier(rng)) for k in range(2 * len(rows))]
    found = {r.doc_id for r in secret_scan.scan(spark.createDataFrame(rows + plain, "doc_id long, text string")).where("n_random > 0").collect()}
    share = {e: np.mean([i in found for i, x in planted.items() if x == e]) for e in set(planted.values())}
    print(n, {e: round(float(x), 2) for e, x in share.items()}, "false", sum(i in found for i, _ in plain), "of", len(found))
    assert all(x >= LEAST[n].get(e, 0.85) for e, x in share.items()), share
    assert sum(i in found for i, _ in plain) <= 0.1 * len(found)


def test_patterned_runs_are_not_random(spark):
    texts = ["abcdefghijklmnopqrstuvwxyz", "0123456789" * 3, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "a" * 40, "a1b2c3d4e5f6g7h8i9j0k1l2", "-" * 30]
    secret = ["".join(np.random.default_rng(zlib.crc32(b"%d" % k)).choice(list(ALPHABETS["base64"]), 40)) for k in range(20)]
    rows = spark.createDataFrame(list(enumerate(texts + secret)), "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan(rows).where("n_random > 0").collect()}
    assert not found & set(range(len(texts))) and len(found) >= 18
