"""How far ordinary text of each encoding and length is from random, measured; `python -m prismora.llm.ordinary` writes ordinary_nulls.py.

Ordinary strings are put together as identifiers, paths, slugs, constants and long words are: from the words of Python's
language reference, with numbers, dates and separators as the encoding allows. Three distances from random are measured
on them and on uniformly random strings: chi-squared of the alphabet, number of runs of character classes, lag-1
correlation, each in standard deviations of random strings. Their linear discriminant is the score. The null is the
normal tail laid through the score's quantiles of 0.05 and 0.001 on ordinary strings, moved until the one of 0.01 is not
below its level either: rates of false finds are decided there, and the score is far from normal above.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

import numpy as np

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
VOWELS = "aeiouAEIOU"
ALPHABETS = {
    "decimal": DIGITS, "hex": DIGITS + LOWER[:6], "HEX": DIGITS + UPPER[:6], "lower": LOWER, "upper": UPPER, "base32": UPPER + "234567", "base36": DIGITS + LOWER, "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Lengths at which the null is measured; a string is held against the longest that is not above its own.
LENGTHS = (16, 18, 20, 22, 24, 28, 32, 40, 48, 64)

#: Levels, and the normal distribution's distances below its middle.
TAIL = ((0.05, 1.645), (0.01, 2.326), (0.001, 3.09))


def classes(encoding: str) -> str:
    """The class of each character of the alphabet: the kinds of characters; vowels and consonants, or halves, where there is one kind."""
    alphabet = ALPHABETS[encoding]
    if encoding == "decimal":
        return "0000011111"
    if encoding in ("lower", "upper"):
        return "".join("01"[c in VOWELS] for c in alphabet)
    return "".join("0" if c.isdigit() else "1" if c.islower() else "2" if c.isupper() else "3" for c in alphabet)


def switching(encoding: str) -> tuple[float, float]:
    """Of a random string: the probability that neighbours differ in class, and the covariance of two such in a row."""
    kinds = classes(encoding)
    q = [kinds.count(c) / len(kinds) for c in sorted(set(kinds))]
    s = 1 - sum(x * x for x in q)
    return s, sum(x * (1 - x) ** 2 for x in q) - s * s


def distances(strings: list[str], encoding: str) -> np.ndarray:
    """(strings, 3): chi-squared, runs and correlation (absolute), in standard deviations of random strings of equal length."""
    alphabet, kinds = ALPHABETS[encoding], np.array(list(map(int, classes(encoding))))
    at = np.array([[alphabet.index(c) for c in s] for s in strings])
    n, k = at.shape[1], len(alphabet)
    squares = sum((at == c).sum(axis=1) ** 2.0 for c in range(k))
    s, both = switching(encoding)
    runs = (np.diff(kinds[at], axis=1) != 0).sum(axis=1)
    x = at - at.mean(axis=1, keepdims=True)
    corr = (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.maximum(1e-9, (x * x).sum(axis=1))
    return np.stack([(k / n * squares - n - (k - 1)) / math.sqrt(2 * (k - 1)), (runs - (n - 1) * s) / math.sqrt((n - 1) * s * (1 - s) + 2 * (n - 2) * both), np.abs(corr) * math.sqrt(n)], axis=1)


def prose() -> list[str]:
    from pydoc_data import topics

    return re.findall(r"\b[a-z]{2,}\b", " ".join(topics.topics.values()).lower())


def ordinary(encoding: str, n: int, count: int, rng: np.random.Generator, words: list[str]) -> list[str]:
    """`count` ordinary strings of n characters of the encoding."""
    alphabet = set(ALPHABETS[encoding])
    hexes = [m for w in words for m in re.findall(r"[a-f]{2,}", w)]

    def figure() -> str:
        kind = rng.integers(5)
        year = f"{rng.integers(1990, 2030)}"
        return (f"{rng.integers(10)}", f"{rng.integers(100)}", year, f"{year}{rng.integers(1, 13):02d}{rng.integers(1, 29):02d}", f"{rng.integers(1000):04d}")[kind]

    def one() -> str:
        style, mark, figures = rng.integers(3), str(rng.choice([c for c in alphabet if not c.isalnum()] or [""])), rng.uniform(0.1, 0.4)
        out, first = "", True
        while len(out) < n:
            if encoding == "decimal":
                out += figure() if rng.random() < 0.8 else "0" * rng.integers(1, 5)
                continue
            w = str(hexes[rng.integers(len(hexes))] if encoding in ("hex", "HEX") else words[rng.integers(len(words))])
            if encoding in ("letters", "base62", "base64", "base64url"):  # camelCase, words, Title
                w = w.capitalize() if style == 0 and not first or style == 2 or encoding == "letters" and first else w.upper() if style == 1 and encoding != "letters" and figures < 0.15 else w
            elif "A" in alphabet:
                w = w.upper()
            out += w + (mark if rng.random() < 0.8 else "")
            if "2" in alphabet and rng.random() < figures:
                out += "".join(c for c in figure() if c in alphabet) + (mark if rng.random() < 0.5 else "")
            first = False
        return out[:n]

    return [one() for _ in range(count)]


def measure(count: int = 6000, seed: int = 1) -> dict[str, dict[int, tuple[float, ...]]]:
    """Of each encoding and length (weight of the three distances, constant): p is the normal distribution at their sum."""
    words, out = prose(), {}
    for encoding, alphabet in ALPHABETS.items():
        out[encoding] = {}
        rng = np.random.default_rng(seed)
        whole = ordinary(encoding, max(LENGTHS), count, rng, words)
        for n in LENGTHS:
            far = distances([s[:n] for s in whole], encoding)
            near = distances(["".join(s) for s in rng.choice(list(alphabet), (count, n))], encoding)
            w = np.linalg.solve(np.cov(far.T) + np.cov(near.T), far.mean(axis=0) - near.mean(axis=0))
            q = np.quantile(far @ w, [level for level, _ in TAIL])
            scale = (q[0] - q[-1]) / (TAIL[-1][1] - TAIL[0][1])
            middle = min(x + z * scale for x, (_, z) in zip(q, TAIL))
            out[encoding][n] = tuple(round(float(x), 4) for x in (*w / scale, -middle / scale))
    return out


if __name__ == "__main__":
    rows = ["    %r: {%s}," % (e, ", ".join(f"{n}: {c}" for n, c in by.items())) for e, by in measure().items()]
    Path(__file__).with_name("ordinary_nulls.py").write_text('"""Written by ordinary.py."""\n\nNULLS = {  # fmt: skip\n' + "\n".join(rows) + "\n}\n")
