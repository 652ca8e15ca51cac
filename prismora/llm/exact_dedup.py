"""Exact deduplication of texts against immutable snapshots.

A snapshot's digests are held in an exact table dealt into buckets, with one static binary-fuse filter per bucket. The
digests of an incoming batch are grouped among themselves, screened by the filter of their bucket, and only positives
join the snapshot's exact table. The least and the greatest text of every group that is found are compared byte by byte.
`store_snapshot` keeps table and filters for later batches, which `against_snapshot` holds against them.

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays
(null is smallest); of several equal rows with that doc_id one stays. Empty tables give empty results; further columns
are ignored by `exact_dedup` and passed on by `drop_exact_copies`, whatever their names. A text may be as long as a
row can be; a group of copies is aggregated before it is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fuse_filter
from .shared import lower_ascii, written

KEYS_PER_FILTER = 400_000


def _digested(docs: DataFrame, id_col: str, text_col: str, snapshot: Column | None, digest_hex: int) -> DataFrame:
    norm = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"), (F.lit(False) if snapshot is None else F.coalesce(snapshot, F.lit(False))).alias("old"))
    rows = rows.withColumn("sha", F.sha2("norm", 256))
    return rows.withColumn("digest", F.unhex(F.substring("sha", 1, digest_hex)))


def _build_filters(group: pd.DataFrame) -> pd.DataFrame:
    f = fuse_filter.build(group["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "seed": [str(f.seed)], "segment": [f.segment], "segments": [f.segments], "slots": [f.slots]})


def _screen(new: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    hit = np.zeros(len(new), bool)
    keys = new["key"].to_numpy(np.int64).view(np.uint64)
    for f in filters.itertuples():
        hit |= fuse_filter.FuseFilter(int(f.seed), int(f.segment), int(f.segments), bytes(f.slots)).contains(keys)
    return new.loc[hit, ["digest"]]


def digest_groups(rows: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """(digest, keep_id, n_top, group_size) of rows (doc_id, digest, old); old rows are the snapshot."""
    spark = rows.sparkSession
    key = F.xxhash64("digest")
    side = (
        rows.groupBy("old", "digest", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("old", "digest").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("n"))
    )
    side = written(side.withColumn("key", key), "digests", spark)
    n = max([r["count"] for r in side.groupBy("old").count().collect()], default=0)  # two rows at most
    buckets = max(1, math.ceil(n / keys_per_filter))
    side = side.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    old, new = side.where("old"), side.where("not old")
    filters = old.select("bucket", "key").groupBy("bucket").applyInPandas(_build_filters, "bucket int, seed string, segment long, segments long, slots binary")
    positives = new.select("bucket", "key", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(_screen, "digest binary")
    # exact buckets: only screened digests meet the snapshot's table
    both = new.join(positives, "digest", "left_semi").select("digest", "top", "n").join(
        old.select("digest", F.col("top").alias("old_top"), F.col("n").alias("old_n")), "digest"
    )
    a, b = F.col("top"), F.col("old_top")
    same = a["doc_id"].eqNullSafe(b["doc_id"])
    top = F.when(same, F.struct(a["doc_id"].alias("doc_id"), (a["n"] + b["n"]).alias("n"))).otherwise(F.greatest(a, b))
    both = written(both.select("digest", top.alias("top"), (F.col("n") + F.col("old_n")).alias("n")), "matched", spark)
    rest = side.select("digest", "top", "n").join(both.select("digest"), "digest", "left_anti")
    return both.unionByName(rest).select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("n_top"), F.col("n").alias("group_size"))


def _found(docs: DataFrame, id_col: str, text_col: str, snapshot: Column | None, digest_hex: int, keys_per_filter: int) -> DataFrame:
    """(doc_id, sha, keep_id, n_top, group_size) of every row."""
    spark = docs.sparkSession
    rows = _digested(docs, id_col, text_col, snapshot, digest_hex)
    slim = written(rows.select("doc_id", "digest", "sha", "old"), "slim", spark)
    groups = written(digest_groups(slim.select("doc_id", "digest", "old"), keys_per_filter), "groups", spark)
    # texts of the groups' members only, for the byte checks
    members = rows.join(groups.where("group_size > 1").select("digest"), "digest", "left_semi").select("doc_id", "digest", "sha", "norm")
    members = written(members, "members", spark)
    differ = members.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest")
    cols = ["doc_id", "sha", "keep_id", "n_top", "group_size"]
    if differ.isEmpty():
        return slim.join(groups, "digest").select(cols)
    # colliding digests: their groups are made anew from the bytes
    clash = written(differ, "clash")
    exact = members.join(clash, "digest", "left_semi")
    again = (
        exact.groupBy("norm", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("norm").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size"))
        .select("norm", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("n_top"), "group_size")
    )
    return slim.join(groups.join(clash, "digest", "left_anti"), "digest").select(cols).union(exact.join(again, "norm").select(cols))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot: Column | None = None, digest_hex: int = 64, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    snapshot: condition of the rows that belong to the immutable snapshot, the others are the incoming batch.
    digest_hex: hex digits of SHA-256 that make the digest; texts whose digests collide are told apart by their bytes.
    """
    found = _found(docs, id_col, text_col, snapshot, digest_hex, keys_per_filter)
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    first = F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("keep_id")) == 1
    marked = found.where("n_top = 1").withColumn("kept", top).unionByName(found.where("n_top > 1").withColumn("kept", top & first))
    return marked.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def store_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keys_per_filter: int = KEYS_PER_FILTER) -> None:
    """Write an immutable snapshot: `path`/texts (its distinct texts by digest, with the doc_id that stays and the size of
    the group) and `path`/filters (a binary-fuse filter a bucket)."""
    rows = _digested(docs, id_col, text_col, None, 64).select("doc_id", "digest", "norm")
    texts = rows.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).withColumn("key", F.xxhash64("digest"))
    texts.write.parquet(f"{path}/texts")
    kept = docs.sparkSession.read.schema(texts.schema).parquet(f"{path}/texts").select("key")
    buckets = max(1, math.ceil(kept.count() / keys_per_filter))
    kept = kept.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    filters = kept.groupBy("bucket").applyInPandas(_build_filters, "bucket int, seed string, segment long, segments long, slots binary")
    filters.withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")


def against_snapshot(batch: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document of the batch: doc_id, seen (its text is in the stored snapshot), keep_id and group_size there.

    A digest that the filter of its bucket rejects is new; positives join the snapshot's texts and are compared with
    them byte by byte. Copies inside the batch are `exact_dedup`'s.
    """
    spark = batch.sparkSession
    filters, texts = spark.read.parquet(f"{path}/filters"), spark.read.parquet(f"{path}/texts")
    some = filters.select("buckets").first()
    rows = _digested(batch, id_col, text_col, None, 64).select("doc_id", "digest", "norm").withColumn("key", F.xxhash64("digest"))
    keys = rows.select("digest", "key").distinct().withColumn("bucket", F.pmod("key", F.lit(some[0] if some else 1)).cast("int"))
    positives = keys.groupBy("bucket").cogroup(filters.drop("buckets").groupBy("bucket")).applyInPandas(_screen, "digest binary")
    known = texts.join(positives, "digest", "left_semi").select("digest", F.col("norm").alias("same"), "keep_id", "group_size", F.lit(True).alias("seen"))
    out = rows.join(known, (rows["digest"] == known["digest"]) & (F.col("norm") == F.col("same")), "left")
    return out.select("doc_id", F.coalesce("seen", F.lit(False)).alias("seen"), "keep_id", "group_size")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshot: Column | None = None, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = _found(docs, id_col, text_col, snapshot, 64, keys_per_filter).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = written(kept.select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), "n_top").distinct(), "kept", docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("sha"))

    def of(part: DataFrame, how: str) -> DataFrame:
        return rows.join(part, F.col("sha").eqNullSafe(F.col("s")) & F.col("id").eqNullSafe(F.col("i")), how)

    plain = of(kept.where("n_top = 1"), "left_semi").select("row.*")
    tied = of(kept.where("n_top > 1"), "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("sha", "id").orderBy("id")))
    return plain.union(tied.where("k = 1").select("row.*"))
