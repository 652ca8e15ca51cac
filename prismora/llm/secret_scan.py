"""Secret scans with DataFrame functions only.

Base spans come from three patterns. The method adds spans of random-looking strings: candidates are all runs of 16 or
more encoding characters, whatever they hold; the encoding of each (decimal, hexadecimal, base 32, base 36, one case or
both cases of letters, base 62, base 64) is the narrowest alphabet that holds its characters. A chi-squared test of
alphabet uniformity, a runs test of character classes and a lag-1 serial correlation test measure how far it is from
random. Their discriminant is held against its distribution on ordinary text of the encoding and length, as measured in
ordinary.py, which gives the p-value of "ordinary text". A run whose runs or correlation miss random by a fixed effect
is patterned, not random, and gets 1. The false-discovery rate over all candidates of the corpus is controlled by the
Benjamini-Hochberg step-up on p-values in bins of a tenth of log10, so that no ranking of all rows is needed.
Long random digits of another use, such as card numbers, can't be told from keys.

Null texts count as empty and have no spans; repeated rows get equal spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordinary import ALPHABETS, LENGTHS, classes, switching
from .ordinary_nulls import NULLS
from .shared import written

# The patterns of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the maximal run after the first AKIA: 16 characters or more in all
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"
KINDS = ["assign", "access", "hex", "random"]
RATE = 0.05
#: Departure of patterned text from random, as a share of the expected runs; correlation.
FAR_RUNS, FAR_CORRELATION = 0.75, 0.75
#: p-values are counted in bins of a tenth of log10.
BINS_A_DECADE = 10


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, kind, end, body) of the leftmost non-overlapping matches, in code points."""
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["a"])
        end = start + F.char_length(pair["b"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), pair["b"].alias("body"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,body:string>>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)["spans"]).otherwise(none)


def normal_cdf(z: Column) -> Column:
    """Phi(z), by the rational approximation of Abramowitz and Stegun 26.2.17, with the tail kept for negative z."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * t * (0.31938153 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, tail).otherwise(1 - tail)


def encoding(body: Column) -> Column:
    """The narrowest alphabet that holds all characters of the string."""
    return (
        F.when(body.rlike("^[0-9]+$"), "decimal").when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX").when(body.rlike("^[a-z]+$"), "lower").when(body.rlike("^[A-Z]+$"), "upper")
        .when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[0-9a-z]+$"), "base36").when(body.rlike("^[0-9A-Z]+$"), "BASE36").when(body.rlike("^[A-Za-z]+$"), "letters")
        .when(body.rlike("^[A-Za-z0-9]+$"), "base62").when(body.rlike("[-_]") & ~body.rlike("[+/]"), "base64url").otherwise("base64")
    )


def _table() -> Column:
    """encoding -> alphabet, classes, switching and the nulls by length."""
    # numbers as one string a row: hundreds of literals make the plan slow
    numbers = lambda e: " ".join(str(x) for x in (*switching(e), *[x for n in LENGTHS for x in NULLS[e][n]]))
    rows = {e: F.struct(F.lit(a).alias("alphabet"), F.lit(classes(e)).alias("classes"), F.lit(numbers(e)).alias("numbers")) for e, a in ALPHABETS.items()}
    return F.create_map(*[x for e, row in rows.items() for x in (F.lit(e), row)])


def p_value(body: Column) -> Column:
    """p-value of "ordinary text of this encoding and length"; 1 where the string is patterned or a test is undefined."""
    raw = F.regexp_replace(body, "=+$", "")
    bound = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  # computed once, however often f names it

    def placed(g: Column) -> Column:
        at = F.transform(F.split(g["raw"], ""), lambda c: F.coalesce(F.instr(g["t"]["alphabet"], c), F.lit(0)))
        return F.struct(g["raw"].alias("raw"), g["t"].alias("t"), at.alias("at"), F.split(g["t"]["numbers"], " ").cast("array<double>").alias("x"), (F.aggregate(at, F.lit(0.0), lambda acc, x: acc + x) / F.size(at)).alias("mean"))

    def measured(g: Column) -> Column:
        n, k, at, mean = F.char_length(g["raw"]).cast("double"), F.char_length(g["t"]["alphabet"]).cast("double"), g["at"], g["mean"]
        chars = F.split(g["raw"], "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(n - F.char_length(F.replace(g["raw"], c, F.lit(""))), F.lit(2.0)))
        far_chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1))
        kinds = F.transform(at, lambda x: F.substr(g["t"]["classes"], x, F.lit(1)))
        runs = F.aggregate(F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds) - 1), lambda a, b: (a != b).cast("double")), F.lit(0.0), lambda acc, x: acc + x)
        spread = F.aggregate(at, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        shared = F.aggregate(F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda acc, x: acc + x)
        row = F.size(F.filter(F.array(*map(F.lit, LENGTHS)), lambda x: x <= n)) - 1
        return F.struct(n.alias("n"), g["x"].alias("x"), far_chi.alias("far_chi"), runs.alias("runs"), F.abs(shared / F.nullif(spread, F.lit(0.0))).alias("corr"), row.alias("row"))

    def judged(m: Column) -> Column:
        n, s, both, runs, corr = m["n"], m["x"][0], m["x"][1], m["runs"], m["corr"]
        null = [F.get(m["x"], 2 + 4 * m["row"] + i) for i in range(4)]
        far_runs = (runs - (n - 1) * s) / F.sqrt((n - 1) * s * (1 - s) + 2 * (n - 2) * both)
        z = null[0] * m["far_chi"] + null[1] * far_runs + null[2] * corr * F.sqrt(n) + null[3]
        patterned = (F.abs(runs - (n - 1) * s) > FAR_RUNS * (n - 1) * s) | (corr > FAR_CORRELATION)
        return F.coalesce(F.when(patterned, 1.0).otherwise(bound(z, normal_cdf)), F.lit(1.0))

    given = bound(raw, lambda r: F.struct(r.alias("raw"), F.element_at(_table(), encoding(r)).alias("t")))
    return bound(bound(bound(given, placed), measured), judged)


def threshold(p_values: DataFrame, rate: float = RATE) -> float:
    """The largest p of the Benjamini-Hochberg step-up at `rate`, from binned counts; 0 where nothing passes."""
    bins = F.greatest(F.lit(0), F.least(F.lit(300 * BINS_A_DECADE), F.floor(-BINS_A_DECADE * F.log10(F.greatest("p", F.lit(1e-300))))))
    counts = p_values.groupBy(bins.alias("bin")).agg(F.count("*").alias("n")).collect()  # at most 300 * BINS_A_DECADE + 1 rows
    total, below, best = sum(r["n"] for r in counts), 0, 0.0
    for r in sorted(counts, key=lambda r: -r["bin"]):
        below += r["n"]
        highest = 10.0 ** (-r["bin"] / BINS_A_DECADE)
        if total * highest <= rate * below:
            best = highest
    return best


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["body"], ASSIGN, 2)) >= 8)
    rows = docs.select(F.col(id_col).alias("doc_id"), assign.alias("a"), spans_of(text, ACCESS, "access").alias("b"), spans_of(text, HEX, "hex").alias("c"), spans_of(text, CANDIDATE, "random").alias("d"))
    rows = rows.select("doc_id", *[F.size(x).cast("long").alias(n) for n, x in (("n_assign", "a"), ("n_access", "b"), ("n_hex", "c"))], F.array_sort(F.concat("a", "b", "c")).alias("base"), "d")
    free = F.filter("d", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), p_value(s["body"]).alias("p")))
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    found = written(rows.select("doc_id", "n_assign", "n_access", "n_hex", slim.alias("base"), more.alias("more")), "spans", docs.sparkSession)
    most = threshold(found.select(F.explode("more.p").alias("p")), rate)
    random = F.transform(F.filter("more", lambda s: s["p"] <= most), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(line(F.col("base")), 256).alias("base_sha256"),
        line(F.concat("base", random)).alias("spans"), F.size(random).cast("long").alias("n_random"),
    )
