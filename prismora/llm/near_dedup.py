"""Near-duplicates by MinHash: universal hash minima, banding, signature verification, exact confirmation, components.

1. Documents with the same shingle set are one class; only classes go on.
2. Each class gets BANDS * ROWS minima of h -> a*h + b (mod 2^64, a odd); a band's minima make a bucket key.
3. First pass: every class is tried against the least and the greatest of the least members of its buckets (stars,
   two pairs a class at most).
4. The links found are joined to components by alternating large-star and small-star.
5. Second pass: buckets that still hold several components are dealt out in block pairs with the full shingle sets.
   A block pair tries every pair across components, in the first bucket that the pair shares, and gives the links of a
   spanning forest only, as pairs of components: no more rows than members, and no link between components is lost.
6. The components so linked are joined once more by the two stars.
In the first pass a candidate is dropped early only where sizes or the signature exclude the threshold; all links are
confirmed on full shingle sets, as 64-bit hashes of the shingles (two different shingles of a pair count as one with a
probability of 5e-20). At similarity 0.8 a pair misses all bands with probability (1 - 0.8^6)^40 = 5e-6.

Null and empty texts, and texts without words, have no shingles and are linked with nothing; they are kept. Repeated
rows have the same set and so the same component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import written
from .text import U, coefficients, mix, ngram_hashes, shingles, slices, split_words, word_hashes

BANDS, ROWS = 40, 6
HASHES = BANDS * ROWS
MARGIN = 0.14  # 5.4 standard errors of the signature's estimate at 0.8
BLOCK, SHINGLES = 1024, 1 << 20  # members of a bucket in one block on average, and shingles of their sets
_A, _B = coefficients(HASHES, 11), coefficients(HASHES, 12)


def signature(x: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, ~U(0))
    buf = np.empty((128, HASHES), U)
    for k in range(0, len(x), 128):
        part = x[k : k + 128, None]
        h = buf[: len(part)]
        np.multiply(part, _A, out=h)
        h += _B
        np.minimum(low, h.min(axis=0), out=low)
    return low


def _sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    words = split_words(column)
    h = word_hashes(words, lower=True)
    for a, b in zip(words.first[:-1], words.first[1:]):
        yield shingles(h[a:b], n)


def _digest(x: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(x.tobytes())


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, sizes, bands, signs = [], [], [], []
            for x in _sets(batch.column(1), n):
                sizes.append(len(x))
                if not len(x):
                    nodes.append(None), bands.append(None), signs.append(None)
                    continue
                low = signature(x)
                key = np.zeros(BANDS, U)
                for r in range(ROWS):
                    key = mix(key + low[r::ROWS])
                nodes.append(_digest(x))
                bands.append(mix(key + np.arange(BANDS, dtype=U)).view(np.int64))
                signs.append((low >> U(48)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "node", "bands", "sign"],
            )

    return run


def _named(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = [_digest(x) if len(x) else None for x in _sets(batch.column(0), n)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), batch.column(0)], names=["node", "text"])

    return run


def _agree(a: bytes, b: bytes) -> float:
    return float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))


def _screened(least: float):
    """Pairs whose sizes and signatures allow the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            ok = [max(x, y) * least <= min(x, y) + 1e-9 and _agree(s, t) >= least - MARGIN for x, y, s, t in zip(d["na"], d["nb"], d["sa"], d["sb"])]
            yield d.loc[ok, ["a", "b"]]

    return run


def _confirmed(n: int, percent: int):
    """Pairs with 100 * intersection >= percent * union of the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "ta"), "tb"):
            keep = []
            for x, y in zip(_sets(batch.column(2), n), _sets(batch.column(3), n)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [x.tobytes() for x in _sets(batch.column(1), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _across(percent: int):
    """Of one block pair of a bucket: pairs of components that a link joins, a spanning forest of them."""

    def run(d: pa.Table) -> pa.Table:
        d = d.take(pc.sort_indices(d, [("node", "ascending")])).combine_chunks()
        name, sets = d.column("comp").to_pylist(), d.column("shingles").combine_chunks()
        comp = d.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).copy()
        size, block = pc.binary_length(sets).to_numpy() // 8, d.column("block").to_numpy()
        bands = d.column("bands").combine_chunks().flatten().to_numpy().reshape(len(size), BANDS)
        earlier = bands[:, : np.flatnonzero(bands[0] == d.column("bucket")[0].as_py())[0]]
        one = d.column("i")[0].as_py() == d.column("j")[0].as_py()
        first = np.cumsum(size) - size
        ids = inside = None
        a, b = [], []
        for k in range(len(size) - 1):
            rest = slice(k + 1, None)
            may = (comp[rest] != comp[k]) & (percent * np.maximum(size[rest], size[k]) <= 100 * np.minimum(size[rest], size[k]))
            if not one:
                may &= block[rest] != block[k]
            at = np.flatnonzero(may) + k + 1
            at = at[~(earlier[at] == earlier[k]).any(axis=1)]  # pairs that share an earlier bucket are tried there
            if not len(at):
                continue
            if ids is None:  # many groups have no such pair
                values, ids = np.unique(np.frombuffer(b"".join(sets.to_pylist()), U), return_inverse=True)
                inside = np.zeros(len(values), np.uint8)
            own = ids[first[k] : first[k] + size[k]]
            inside[own] = 1
            if 4 * size[at].sum() < len(ids):
                both = np.array([inside[ids[first[x] : first[x] + size[x]]].sum(dtype=np.int64) for x in at])
            else:
                both = np.add.reduceat(inside[ids], first, dtype=np.int64)[at]
            inside[own] = 0
            for x in at[100 * both >= percent * (size[k] + size[at] - both)]:
                if comp[x] != comp[k]:
                    comp[comp == comp[x]] = comp[k]
                    a.append(name[k]), b.append(name[x])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def near_links(classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Component (node, component) of the linked classes. classes: node, n, bands, sign; texts: node, text."""
    spark = classes.sparkSession
    least = percent / 100
    member = classes.select("node", F.explode("bands").alias("bucket"))
    head = member.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("members")).where("members > 1").drop("members")
    member = written(member.join(head, "bucket"), "members", spark)
    slim = classes.select("node", "n", "sign")
    # one text of each class that shares a bucket
    texts = written(texts.join(member.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "texts", spark)

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirmed(n, percent), "a binary, b binary")

    heads = member.where("node <> head").groupBy("node").agg(F.array_distinct(F.array(F.min("head"), F.max("head"))).alias("heads"))
    star = heads.select(F.explode("heads").alias("a"), F.col("node").alias("b"))
    star = (
        star.join(slim.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa")), "a")
        .join(slim.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb")), "b")
        .mapInPandas(_screened(least), "a binary, b binary")
    )
    links = written(confirm(star), "links", spark)
    comp = written(components(links), "components", spark)

    # second pass: buckets that still hold several components
    member = member.join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    size = slim.select("node", "n")
    mixed = member.join(size, "node").groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("members"), F.sum("n").alias("total")).where("x <> y")
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("total") / SHINGLES)).cast("int")
    member = member.join(mixed.select("bucket", blocks.alias("blocks")), "bucket")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = written(member.withColumn("block", block).withColumn("pair", F.explode(pairs)).select("bucket", "node", "comp", "block", "pair.i", "pair.j"), "dealt", spark)
    sets = texts.join(dealt.select("node").distinct(), "node", "left_semi").mapInArrow(_with_sets(n), "node binary, shingles binary")
    pairs = dealt.join(sets, "node").join(classes.select("node", "bands"), "node").groupBy("bucket", "i", "j").applyInArrow(_across(percent), "a binary, b binary")
    more = written(pairs, "links", spark)
    if more.isEmpty():
        return comp
    moved = written(components(more), "components", spark)
    grown = comp.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    fresh = moved.join(comp.select("node"), "node", "left_anti")
    return written(grown.select("node", F.coalesce("to", "component").alias("component")).union(fresh.select("node", "component")), "components", spark)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id of its component), kept, text_key.

    kept: doc_id = component_id. Links: 100 * intersection >= percent * union of the sets of distinct shingles of
    `words` words, A-Z lower-cased; a shorter text counts whole as one shingle, one without words has none.
    text_key is the xxhash64 of the text, to tell rows with one doc_id apart.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_signed(words), f"doc_id {kind}, text_key long, n_shingles long, node binary, bands array<long>, sign binary")
    signed = written(signed, "signed", spark)
    sized = signed.select("doc_id", "text_key", "n_shingles", "node")
    classes = signed.where("node is not null").select("node", F.col("n_shingles").alias("n"), "bands", "sign").dropDuplicates(["node"])
    classes = written(classes, "classes", spark)
    named = rows.select("text").mapInArrow(_named(words), "node binary, text string")
    comp = near_links(classes, named, words, percent)
    out = sized.join(comp, "node", "left").withColumn("c", F.coalesce("component", "node"))
    out = written(out.select("doc_id", "text_key", "n_shingles", "c"), "placed", spark)
    least = out.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"))
    linked = out.where("c is not null").join(least, "c")
    alone = out.where("c is null").withColumn("component_id", F.col("doc_id"))
    cols = ["doc_id", "n_shingles", "component_id", "text_key"]
    both = linked.select(cols).union(alone.select(cols)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return both.select("doc_id", "n_shingles", "component_id", "kept", "text_key")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each component, with all their columns; of equal rows one stays."""
    spark = docs.sparkSession
    kept = near_dedup(docs, id_col, text_col, words, percent).where("kept")
    kept = kept.groupBy(F.col("doc_id").alias("i"), F.col("text_key").alias("k")).agg(F.count("*").alias("times"), F.max("n_shingles").alias("n"))
    kept = written(kept, "kept", spark)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))

    def of(part: DataFrame) -> DataFrame:
        return rows.join(part, F.col("key").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i")), "left_semi")

    plain = of(kept.where("times = 1 or n = 0")).select("row.*")
    tied = of(kept.where("times > 1 and n > 0")).withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("id")))
    return plain.union(tied.where("nth = 1").select("row.*"))
