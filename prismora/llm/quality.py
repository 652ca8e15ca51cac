"""Quality rules: text statistics, fixed base rules, and a learned decision list.

Sequential covering grows conjunctions of thresholds on the statistics by FOIL gain, prunes each on held-out rows
(as RIPPER does), and stops when a rule is no better than the default. The ordered list becomes one Spark CASE
expression. It is fitted on labelled rows only: at most `sample` of them, those with the least hash of doc_id.

Null texts have no words; empty tables give empty results; repeated rows get the same verdict. Null labels are left
out; without labels of both classes the list is empty and every document passes the method.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import U, lean, mix, ngram_hashes, slices, span_hashes, split_words, word_hashes

WINDOW = 8
SAMPLE = 20_000
BYTES = 512 << 10  # of text that is counted at once
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_digits", "n_upper", "n_punct"]
#: Statistic: numerator, denominator.
RATIOS = {
    "words": ("n_words", None), "mean_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"),
    "repeated": ("n_repeat_words", "n_words"), "digits": ("n_digits", "n_chars"), "upper": ("n_upper", "n_chars"), "punctuation": ("n_punct", "n_chars"), "words_per_line": ("n_words", "n_lines"),
}
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_PUNCT = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()-", np.uint8))


def _per_doc(flags: np.ndarray, docs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[docs[1:]] - total[docs[:-1]]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each key: does it occur before (1) or only later (0) among the keys of its owner? -1: it is alone."""
    tagged = mix(keys ^ mix(owner.astype(U) + U(1)))
    order = np.argsort(tagged, kind="stable")
    same = tagged[order][1:] == tagged[order][:-1]
    out = np.full(len(keys), -1, np.int8)
    out[order[:-1][same]] = 0
    out[order[1:][same]] = 1
    return out


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    w = split_words(column)
    docs = w.docs
    lead = w.data & 0xC0 != 0x80  # first byte of a code point
    out = {"n_words": w.counts, "n_chars": _per_doc(lead, docs)}
    total = np.zeros(len(lead) + 1, np.int64)
    np.cumsum(lead, out=total[1:])
    chars = np.zeros(len(w.starts) + 1, np.int64)
    np.cumsum(total[w.ends] - total[w.starts], out=chars[1:])
    out["word_chars"] = chars[w.first[1:]] - chars[w.first[:-1]]
    for name, table in (("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_upper", _UPPER), ("n_punct", _PUNCT)):
        out[name] = _per_doc(table[w.data], docs)
    # lines that hold a word
    cuts = np.flatnonzero(w.data == 10)
    begins = np.unique(np.concatenate([docs[:-1], cuts + 1]))
    begins = begins[begins < len(w.data)]
    stops = np.append(begins[1:], len(w.data))
    newline = np.zeros(len(stops), bool)
    newline[stops > begins] = w.data[stops[stops > begins] - 1] == 10
    stops = stops - newline
    full = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begins)
    begins, stops = begins[full], stops[full]
    owner = np.searchsorted(docs, begins, "right") - 1
    again = _repeats(span_hashes(w.data, begins, stops), owner) == 1
    n = len(docs) - 1
    out["n_lines"] = np.bincount(owner, minlength=n)[:n]
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)[:n]
    # words covered by an 8-word window that occurs more than once in its text
    h = ngram_hashes(word_hashes(w), WINDOW)
    doc_of = np.repeat(np.arange(n), w.counts)
    if len(h):
        inside = doc_of[: len(h)] == doc_of[WINDOW - 1 :]
        at = np.flatnonzero(inside)
        at = at[_repeats(h[at], doc_of[at]) >= 0]
        edge = np.zeros(len(doc_of) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        out["n_repeat_words"] = np.bincount(doc_of[covered], minlength=n)[:n]
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=BYTES):
        found = counts_of(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["doc_id", *COUNTS])


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of COUNTS, from whole texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_counted), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def ratio(name: str) -> Column:
    top, below = RATIOS[name]
    return F.col(top).cast("double") if below is None else F.col(top) / F.greatest(F.col(below), F.lit(1))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass
class Rule:
    """All of `tests` (statistic, "<=" or ">", threshold) hold: the verdict is bad."""

    tests: list[tuple[str, str, float]]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, op, cut in self.tests:
            hit &= x[name] <= cut if op == "<=" else x[name] > cut
        return hit

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.tests:
            out = out & ((ratio(name) <= cut) if op == "<=" else (ratio(name) > cut))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {c:g}" for n, o, c in self.tests)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule = Rule([])
    hit = np.ones(len(bad), bool)
    while len(rule.tests) < longest and not bad[hit].all():
        p0, n0 = bad[hit].sum(), (~bad[hit]).sum()
        best = (1e-9, None, None)
        for name, v in x.items():
            inside = v[hit]
            for cut in np.unique(np.quantile(inside, np.linspace(0, 1, cuts + 2)[1:-1], method="lower")):
                for op, take in (("<=", inside <= cut), (">", inside > cut)):
                    p, n = bad[hit][take].sum(), (~bad[hit][take]).sum()
                    if p and (p + n) < (p0 + n0):
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best[0]:
                            best = (gain, (name, op, float(cut)), take)
        if best[1] is None:
            break
        rule.tests.append(best[1])
        hit[np.flatnonzero(hit)[~best[2]]] = False
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float]:
    """The prefix of the rule with the best (p - n) / (p + n) on held-out rows, longer ones only if better."""

    def worth(r: Rule) -> float:
        hit = r.covers(x)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    tried = [Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)]
    if not tried:
        return rule, -1.0
    best = max(tried, key=lambda r: (worth(r), -len(r.tests)))
    return best, worth(best)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, max_rules: int = 12, cuts: int = 64, longest: int = 4) -> list[Rule]:
    """An ordered list of rules for the bad class; a rule must reach `precision` on the rows it was pruned on."""
    prune = np.arange(len(bad)) % 3 == 2
    rest, rules = np.ones(len(bad), bool), []
    while len(rules) < max_rules and bad[rest & ~prune].any() and (~bad[rest & ~prune]).any():
        fit, held = rest & ~prune, rest & prune
        rule = _grow({k: v[fit] for k, v in x.items()}, bad[fit], cuts, longest)
        rule, worth = _prune(rule, {k: v[held] for k, v in x.items()}, bad[held])
        hit = rule.covers(x) & rest
        if not rule.tests or not hit.any() or (1 + worth) / 2 < precision or bad[hit].mean() < precision:
            break
        rules.append(rule)
        rest &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options: float) -> list[Rule]:
    """Learn from labelled documents (doc_id, text); labels: doc_id, quality (1 good, 0 bad).

    The `sample` label rows with the least hash of doc_id are used: that bounds what is broadcast and collected.
    """
    given = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    given = given.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    counts = text_counts(docs.join(F.broadcast(given.select("doc_id").distinct()), "doc_id", "left_semi"))
    rows = counts.join(F.broadcast(given), "doc_id").select("doc_id", "quality", *[ratio(n).alias(n) for n in RATIOS]).toPandas()
    rows = rows.sort_values(["doc_id", "quality", *RATIOS], ignore_index=True).sample(frac=1, random_state=0)
    if rows["quality"].nunique() < 2:
        return []
    return learn({n: rows[n].to_numpy(float) for n in RATIOS}, rows["quality"].to_numpy() == 0, **options)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: the first rule that holds rejects."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    return counts.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = judged(text_counts(wanted), fit(wanted, labels, sample))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _passed(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows = whole.column(0)
            text = rows.field(rows.type.get_field_index(text_col)) if len(rows) else pa.array([], pa.string())
            for batch in slices(iter([pa.RecordBatch.from_arrays([rows, text], names=["row", "text"])]), limit=BYTES):
                found = counts_of(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], names=["row", *COUNTS])

    return run


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, sample)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    counted = rows.mapInArrow(lean(_passed(text_col)), f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))
    return judged(counted, rules).where("kept").select("row.*")
