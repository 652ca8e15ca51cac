"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of `block_words` words. Each source's target (its share by weight, at most `most` times
its size, the excess reshared) gives an exact number of blocks: whole passes over the source, and a last pass that
draws part of its blocks without replacement. The block quotas of all sources are split recursively among the output
shards: each node of a binary tree gives its left half a multivariate-hypergeometric share. A shard then takes a
consecutive range of ranks of each source's permutation of its blocks, so that draws of one pass are disjoint and
no sort by source is needed: the permutation is a keyed Feistel network on the block's index in its source. Rows are
shuffled within their shard by sorting on a hash of their place in their source's draws.

Documents are read once and packed into compressed chunks in the shared folder; everything up to the draws works on a
slim row per document, and the task that cuts a chunk's blocks reads that chunk by its place. A task that is lost
leaves a file that no row names.

Everything follows from doc_id, text, source and the seed, so reruns agree. A null text has size 0 and is never taken;
null sources are a source, last in order; repeated rows are separate documents; equal doc_ids are ordered by a hash of
their texts, and rows equal in both stand for each other. A text may be as long as one task's memory holds. Further
columns are kept by `mixed`, whatever their names, and ignored otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import append, parallelism, shared_dir, written
from .text import U, mix, slices, split_words

BLOCK_WORDS = 64
BUCKET_ROWS = 20_000
SHARD_WORDS = 4_000_000  # words in a shard on average, whether blocks or whole documents are dealt
CHUNK_BYTES = 8 << 20
CHUNKS_A_TASK = 8
WAVES = 4
MAX_SOURCES = 100_000  # they are collected and shipped to all tasks: 10 MB at most
TREE_NODES = 1_000_000  # numbers of the splitting tree that a task remembers


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight, none above most * size; the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        whole = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / whole > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / whole
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in over]
    return out


class Tree:
    """Quotas of all sources split among shards by recursive halving, each node looked up alone.

    A node (lo, hi) of the shards gives its left half an exact number of draws, divided among the sources by a
    multivariate-hypergeometric draw. That draw is itself made by halving the range of sources, one hypergeometric
    number a range, seeded by node and range: any process finds the same numbers, visiting only the path it needs.
    """

    def __init__(self, quotas: list[int], shards: int, seed: int):
        self.before = np.concatenate([[0], np.cumsum(np.asarray(quotas, np.int64))])
        self.shards, self.seed = shards, seed
        self.memo: dict[tuple[int, int, int, int], int] = {}

    def have(self, node: tuple, i: int, j: int) -> int:
        """Draws of sources i..j-1 in the node; a node is its path of (lo, hi) from the root."""
        if len(node) == 1:
            return int(self.before[j] - self.before[i])
        lo, _ = node[-1]
        left = self.left(node[:-1], i, j)
        return left if lo == node[-2][0] else self.have(node[:-1], i, j) - left

    def left(self, node: tuple, i: int, j: int) -> int:
        """Of these, the draws of the left half."""
        lo, hi = node[-1]
        if (found := self.memo.get((lo, hi, i, j))) is not None:
            return found
        last = len(self.before) - 1
        if (i, j) == (0, last):
            out = self.have(node, 0, last) * ((lo + hi) // 2 - lo) // (hi - lo)
        else:
            a, b = self._parent(i, j, last)
            mid = (a + b) // 2
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi, a, b]))
            first = _hypergeometric(rng, self.have(node, a, mid), self.have(node, mid, b), self.left(node, a, b))
            out = first if i == a else self.left(node, a, b) - first
        if len(self.memo) >= TREE_NODES:
            self.memo.clear()
        self.memo[lo, hi, i, j] = out
        return out

    @staticmethod
    def _parent(i: int, j: int, last: int) -> tuple[int, int]:
        """The range of sources that was halved to i..j-1."""
        a, b = 0, last
        while True:
            mid = (a + b) // 2
            if (a, mid) == (i, j) or (mid, b) == (i, j):
                return a, b
            a, b = (a, mid) if j <= mid else (mid, b)

    def shards_of(self, source: int, at: np.ndarray) -> np.ndarray:
        """The shard of each place in the sequence of the source's draws."""
        out = np.zeros(len(at), np.int64)
        todo = [(((0, self.shards),), np.arange(len(at)), 0)]
        while todo:
            node, who, start = todo.pop()
            lo, hi = node[-1]
            if not len(who) or hi - lo == 1:
                out[who] = lo
                continue
            mid, left = (lo + hi) // 2, self.left(node, source, source + 1)
            in_left = at[who] < start + left
            todo.append(((*node, (lo, mid)), who[in_left], start))
            todo.append(((*node, (mid, hi)), who[~in_left], start + left))
        return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """All of a tree's quotas (shards, sources); row sums are as even as can be, column sums exact."""
    tree = Tree(quotas, shards, seed)
    out = np.zeros((shards, len(quotas)), np.int64)
    for k, n in enumerate(quotas):
        np.add.at(out[:, k], tree.shards_of(k, np.arange(n)), 1)
    return out


def _hypergeometric(rng: np.random.Generator, n: int, rest: int, take: int) -> int:
    """How many of `take` draws without replacement from n + rest hit the n."""
    if not take or not n or not rest:
        return min(n, take)
    if n + rest < 1_000_000_000:
        return int(rng.hypergeometric(n, rest, take))
    # beyond the generator's range: its normal limit, held to what is possible
    m = take * n / (n + rest)
    sd = math.sqrt(max(0.0, m * (rest / (n + rest)) * ((n + rest - take) / max(1, n + rest - 1))))
    return int(min(n, take, max(take - rest, 0, round(rng.normal(m, sd)))))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed bijection of 0..size-1 for each row: a four-round Feistel network, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))) + 1).astype(np.int64) // 2).astype(U)
    low = (U(1) << half) - U(1)
    x, todo = index.astype(U), np.ones(len(index), bool)
    limit = size.astype(U)
    while todo.any():
        v, h, m, k = x[todo], half[todo], low[todo], key[todo]
        a, b = v >> h, v & m
        for r in range(4):
            a, b = b, a ^ (mix(b + k + U((r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & m)
        x[todo] = a << h | b
        todo[np.flatnonzero(todo)[x[todo] < limit[todo]]] = False
    return x.astype(np.int64)


@dataclass
class Source:
    source: str | None
    size: int
    blocks: int
    code: int  # place in code point order
    target: float
    passes: int  # whole passes
    drawn: int  # blocks of the last, partial pass


def plan(rows: list, weights: tuple[float, ...], share: float, most: float, unit: int | None) -> list[Source]:
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))  # str order is code point order
    sizes = [int(r["size"] or 0) for r in rows]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(rows))], share * sum(sizes), most)
    out = []
    for k, (r, t) in enumerate(zip(rows, goal)):
        blocks = int(r["blocks"] or 0)
        passes, drawn = divmod(round(t / sizes[k] * blocks), blocks) if blocks else (0, 0)
        if not unit and blocks:  # whole documents: the last pass stops by words, see _filled
            passes, drawn = int(t // sizes[k]), 0
        out.append(Source(r["source"], sizes[k], blocks, k, t, passes, drawn))
    return out


def _pack(root: str, text_col: str):
    """Documents into one file a task, in compressed chunks of bounded size; a row per document says where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        name, out = uuid.uuid4().hex, None
        for whole in batches:
            if not whole.num_rows:
                continue
            row = whole.column(0)
            text = row.field(row.type.get_field_index(text_col))
            given = pa.RecordBatch.from_arrays([row, text, *whole.columns[1:]], names=["row", "text", "doc_id", "source", "text_key"])
            for batch in slices(iter([given]), limit=CHUNK_BYTES):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}")
                at, n = out.tell(), batch.num_rows
                only = batch.select(["row"])
                with pa.ipc.new_stream(out, only.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(only)
                chunk = f"{name}:{at}:{out.tell() - at}"
                size = split_words(batch.column(1)).counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n), pa.array(np.arange(n, dtype=np.int32)), *batch.columns[2:], pa.array(size)], names=["chunk", "nth", "doc_id", "source", "text_key", "size"])
        if out is not None:
            out.close()

    return run


def _unpack(root: str, chunk: str) -> pa.StructArray:
    fs, base = pafs.FileSystem.from_uri(root)
    name, at, length = chunk.split(":")
    with fs.open_input_file(f"{base}/{name}") as f:
        f.seek(int(at))
        return pa.ipc.open_stream(f.read(int(length))).read_all().column("row").combine_chunks()


@dataclass
class Draws:
    root: str  # folder of the packed documents
    row_type: pa.DataType
    documents: DataFrame  # chunk, nth, doc_id, source, size, blocks, start (its first block in its source)
    draws: DataFrame  # chunk, nth, doc_id, source, start, draws: array of (block, shard, slot)
    sources: list[Source]
    shards: int


def draws(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int | None = BLOCK_WORDS, shards: int | None = None, seed: int = 17) -> Draws:
    """Pack the documents and decide every block that the mix takes, once for each time it is taken.

    A shard is its draws by slot. block_words None: a document is one block, and the last pass stops at the document
    that brings its source's words nearest to the target.
    """
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    row = F.struct(*[F.col(c) for c in docs.columns])
    given = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_key"))
    kind = given.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(_pack(root, text_col), f"chunk string, nth int, doc_id {kind}, source string, text_key long, size long")
    rows = written(rows, "sized", spark)
    n = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    # buckets by hash split hot sources; a document's first block: its bucket's start plus a running sum inside
    blocks = F.ceil(F.col("size") / F.lit(block_words)).cast("long") if block_words else F.when(F.col("size") > 0, 1).otherwise(0).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n)).cast("int"))
    per = written(rows.groupBy("source", "bucket").agg(F.sum("blocks").alias("b"), F.sum("size").alias("s")), "buckets", spark)
    found = per.groupBy("source").agg(F.sum("s").alias("size"), F.sum("b").alias("blocks")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: their targets are computed on the driver")
    sources = plan(found, weights, share, most, block_words)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("blocks").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    placed = placed.select("chunk", "nth", "doc_id", "source", "size", "blocks", (F.col("before") + F.col("inside")).alias("start"))
    placed = written(placed, "placed", spark)
    if not block_words:
        _filled(placed.where("blocks > 0"), sources, seed)
    shards = shards or max(1, math.ceil(sum(s.target for s in sources) / SHARD_WORDS))
    taken = placed.where("blocks > 0").select("chunk", "nth", "doc_id", "source", "start", "blocks").mapInArrow(
        _drawn(sources, shards, seed), f"chunk string, nth int, doc_id {kind}, source string, start long, draws array<struct<block:int,shard:int,slot:long>>"
    )
    return Draws(root, to_arrow_type(given.schema["row"].dataType), placed, written(taken, "draws", spark), sources, shards)


def _rank(index: np.ndarray, total: np.ndarray, code: np.ndarray, p: np.ndarray | int, seed: int) -> np.ndarray:
    """Place of a block in the permutation of its source's blocks that pass p takes."""
    return permuted(index, total, mix(code.astype(U) * U(1_000_003) + U(seed * 64) + np.asarray(p).astype(U)))


def _filled(placed: DataFrame, sources: list[Source], seed: int) -> None:
    """Set each source's `drawn`: documents of the last pass, in permuted order, up to the words that are left.

    Words are summed by buckets of ranks, and row by row only in the one bucket of each source where the sum stops.
    """
    spark = placed.sparkSession
    info = {s.source: (s.blocks, s.passes, s.code) for s in sources}

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            total, p, code = _columns(info, d["source"])
            yield pd.DataFrame({"code": code, "rank": _rank(d["start"].to_numpy(np.int64), total, code, p, seed), "size": d["size"]})

    ranks = written(placed.select("source", "start", "size").mapInPandas(ranked, "code long, rank long, size long"), "ranks", spark)
    ranks = ranks.withColumn("bucket", F.floor(F.col("rank") / BUCKET_ROWS))
    before = Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(ranks.groupBy("code", "bucket").agg(F.sum("size").alias("words")), "sums", spark)  # dealt by bucket, not by source alone
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    left = spark.createDataFrame([(s.code, float(s.target - s.passes * s.size)) for s in sources if s.blocks], "code long, rest double")
    stop = sums.join(F.broadcast(left), "code").where("before <= rest and rest < before + words")  # a row a source
    upto = Window.partitionBy("code").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    last = ranks.join(F.broadcast(stop.select("code", "bucket", "before", "rest")), ["code", "bucket"])
    last = last.withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2)
    for r in last.groupBy("code", "bucket").agg(F.count_if(F.col("sum") <= F.col("rest")).alias("n")).collect():
        sources[r["code"]].drawn = int(r["bucket"] * BUCKET_ROWS + r["n"])


def _columns(info: dict, names: pd.Series | list) -> np.ndarray:
    return np.array([info[None if s is None or s != s else s] for s in names], np.int64).T


def _drawn(sources: list[Source], shards: int, seed: int):
    info = {s.source: (s.blocks, s.passes, s.drawn, s.code) for s in sources}
    quotas = [s.passes * s.blocks + s.drawn for s in sources]
    schema = pa.list_(pa.struct([("block", pa.int32()), ("shard", pa.int32()), ("slot", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(quotas, shards, seed)
        for batch in batches:
            for d in _bounded(batch):
                count = d.column("blocks").to_numpy()
                who = np.repeat(np.arange(len(count)), count)
                nth = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
                index = d.column("start").to_numpy()[who] + nth
                total, passes, drawn, code = _columns(info, d.column("source").to_pylist())[:, who]
                parts = []
                for p in range(int(passes.max(initial=0)) + 1):
                    rank = _rank(index, total, code, p, seed)
                    take = np.flatnonzero((p < passes) | (p == passes) & (rank < drawn))
                    at = p * total[take] + rank[take]  # place in its source's sequence of draws
                    shard = np.zeros(len(take), np.int64)
                    for c in np.unique(code[take]):
                        own = code[take] == c
                        shard[own] = tree.shards_of(int(c), at[own])
                    slot = mix(at.astype(U) * U(1 << 20) + code[take].astype(U)).view(np.int64)
                    parts.append((who[take], nth[take], shard, slot))
                owner, block, shard, slot = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((block, owner))
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(count)))])
                items = pa.StructArray.from_arrays([pa.array(block[order], pa.int32()), pa.array(shard[order], pa.int32()), pa.array(slot[order])], fields=list(schema.value_type))
                yield pa.RecordBatch.from_arrays([*[d.column(c) for c in ("chunk", "nth", "doc_id", "source", "start")], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], names=["chunk", "nth", "doc_id", "source", "start", "draws"])

    return run


def _bounded(batch: pa.RecordBatch, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `most` blocks; one longer document stays alone."""
    ends = np.cumsum(batch.column("blocks").to_numpy())
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _by_chunk(d: Draws, function, schema: str) -> DataFrame:
    """function(rows of the chunk, its draws as a table) for every chunk that has draws."""

    root, spark = d.root, d.draws.sparkSession

    def run(given: pa.Table) -> pa.Table:
        return function(_unpack(root, given.column("chunk")[0].as_py()), given.combine_chunks())

    tasks = max(parallelism(spark), math.ceil(d.draws.agg(F.countDistinct("chunk")).first()[0] / CHUNKS_A_TASK))  # by chunks, as their rows here are small
    return d.draws.repartition(tasks, "chunk").groupBy("chunk").applyInArrow(run, schema)


def _flat(given: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row of `given` of each draw, the draws' columns)."""
    lists = given.column("draws").combine_chunks()
    items = lists.flatten()
    who = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return who, {c: items.field(k).to_numpy() for k, c in enumerate(("block", "shard", "slot"))}


def _cut(text_col: str, unit: int, lo: int, hi: int):
    """Texts of the drawn blocks of shards lo..hi-1: each from its first word to before the first word of the next."""

    def run(rows: pa.StructArray, given: pa.Table) -> pa.Table:
        w = split_words(rows.field(rows.type.get_field_index(text_col)))
        who, draw = _flat(given)
        keep = (draw["shard"] >= lo) & (draw["shard"] < hi)
        who, draw = who[keep], {c: x[keep] for c, x in draw.items()}
        doc = given.column("nth").to_numpy()[who]
        first = w.first[doc] + unit * draw["block"].astype(np.int64)
        last = first + unit
        over = last >= w.first[doc + 1]
        ends = np.where(over, w.docs[doc + 1], w.starts[np.minimum(last, len(w.starts) - 1)] if len(w.starts) else 0)
        begins = w.starts[first] if len(first) else first
        body = w.data.tobytes()
        texts = pa.array([body[a:b] for a, b in zip(begins.tolist(), ends.tolist())], pa.binary()).cast(pa.string())
        return pa.table({**{c: given.column(c).take(pa.array(who)) for c in ("doc_id", "source", "start")}, "block": pa.array(draw["block"]), "slot": pa.array(draw["slot"]), "text": texts, "shard": pa.array(draw["shard"])})

    return run


def write_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, waves: int = WAVES, **options) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(mix, documents, sources): the mix written as one folder a shard, its rows in the shard's order, and read back.

    mix: doc_id, source, start (of the document), block, slot, text (of the block), shard. The shards are written in
    `waves`: each shuffles and then drops its share of the texts, so that local disks hold only one share at a time.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    d = draws(slim, block_words=block_words, **options)
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, source string, start long, block int, slot long, text string, shard int"
    path = f"{shared_dir(spark)}/mix-{uuid.uuid4().hex}"
    edges = [d.shards * k // waves for k in range(waves + 1)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo < hi:
            part = _by_chunk(d, _cut("text", block_words, lo, hi), schema)
            part = part.repartition(max(parallelism(spark), hi - lo), "shard").sortWithinPartitions("shard", "slot")
            append(part, path, "shard")
    return spark.read.schema(schema).parquet(path), d.documents, d.sources


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words in the written mix, repeats counted)."""
    mix, placed, sources = write_mix(docs, **options)
    taken = mix.groupBy(F.col("source").alias("s"), F.col("start").alias("a")).agg(F.sum(word_count(F.col("text"))).alias("taken"))
    rows = placed.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("a")) & (F.col("blocks") > 0), "left")
    about = docs.sparkSession.createDataFrame([(s.source, s.size, float(s.target)) for s in sources], "t string, source_size long, target double")
    rows = rows.join(about, F.col("source").eqNullSafe(F.col("t")))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix of whole documents, with all their columns: a document comes once for each time it is drawn, in the order of its shard."""
    d = draws(docs, id_col, text_col, source_col, block_words=None, **options)

    def whole(rows: pa.StructArray, given: pa.Table) -> pa.Table:
        who, draw = _flat(given)
        return pa.table({"row": rows.take(pa.array(given.column("nth").to_numpy()[who])), "shard": pa.array(draw["shard"]), "slot": pa.array(draw["slot"])})

    out = _by_chunk(d, whole, f"row {docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias('row')).schema['row'].dataType.simpleString()}, shard int, slot long")
    return out.repartition("shard").sortWithinPartitions("shard", "slot").select("row.*")
