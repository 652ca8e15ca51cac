"""Vocabulary files and exact encoders shared by the token operators. Paths are parameters, nothing is copied."""

from __future__ import annotations

import base64
import functools
import json
import os
import re


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def rank_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(4)
def json_encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(4)
def cuts_at_spaces(path: str) -> bool:
    """Does this tokenizer drop white space before its merges, so that a text's ids are those of its space-separated parts?

    True for a normaliser of NFC, runs of white space to one space, and lower-casing, then a split that keeps only
    matches without white space.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    first = cuts[0]
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and not re.search(r"(?<!\^)\\s", first["pattern"].get("Regex", "\\s"))
    rest = all(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in cuts[1:])
    return bool(plain and split and rest and not spec.get("post_processor") and not spec.get("truncation"))


#: Letters, single digits, and runs of anything else but white space, after lower-casing; contractions hold an apostrophe.
CLASSES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.lru_cache(4)
def word_rules(path: str) -> tuple[bool, bool, bytes]:
    """Of a tokenizer that cuts at spaces: does it lower-case, does it cut where letters, digits and others meet, and
    the bytes that keep a word whole: those an added token may begin with, and the apostrophe."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    lower = any(s["type"] == "Lowercase" for s in (spec.get("normalizer") or {}).get("normalizers", []))
    first = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    begins = {x.encode()[:1] for t in spec.get("added_tokens") or [] for x in (t["content"], t["content"].lower(), t["content"].upper())}
    return lower, first.get("pattern") == {"Regex": CLASSES}, b"'" + b"".join(sorted(begins))


class Memo(dict):
    """Values of frequent keys in two generations of bounded size: a key that is asked for again outlives the turn-over."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys) -> list:
        """Keys without a value; all others are in this dictionary afterwards."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        old, new = self.old, []
        for k in keys:
            if k not in self:
                v = old.get(k)
                if v is None:
                    new.append(k)
                else:
                    self[k] = v
        return new
