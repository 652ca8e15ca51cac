"""Chat formatting into a prefix tree of turns.

Conversations that share their first turns share tree nodes: a node is a chain of turns from the first, keyed by a
hash of its parent's key, role and text. The tree is emitted once, depth first: nodes are ordered by the keys of the
branches on their path (a chain without branches needs none), which a range-partitioned sort does without holding a
tree in one place. A node carries its place in the stream, its position id (code points of its ancestors) and the
intervals of the stream that its ancestors fill, which are what it attends to besides itself.

Template: ``<s>role[INST]text[/INST]</s>`` for each turn. A control string inside a role or text gets a backslash after
its first character, one more than it has there, so that unescaping is exact. Positions count code points.

Rows of a conversation are ordered by turn (null first), then role and text; repeated rows are turns of their own.
Null texts count as empty, null roles as the empty role; a null conv_id is a conversation. conv_ids are whole numbers:
other types raise, where ANSI mode is on, or else are null. A turn is formatted in one piece, however long; further
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parallelism, written

_ESCAPE = re.compile(r"([<\[])(\\*)(?=/?s>|/?INST\])")
_UNESCAPE = re.compile(r"([<\[])(\\*)\\(?=/?s>|/?INST\])")
_TURN = re.compile(r"<s>(.*?)\[INST\](.*)\[/INST\]</s>", re.S)
ROOT = b""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] + m[2] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def format_turn(role: str, text: str) -> str:
    return f"<s>{escape(role)}[INST]{escape(text)}[/INST]</s>"


def parse_turn(segment: str) -> tuple[str, str]:
    m = _TURN.fullmatch(segment)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def _rows(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from batch.slice(k, size).to_pylist()


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition(parallelism(df.sparkSession), "conv_id").sortWithinPartitions("conv_id", *order)


_STEP = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent", pa.binary()), ("key", pa.binary()), ("segment", pa.string()), ("chars", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now, parent, depth = object(), ROOT, 0
        for r in _rows(batches):
            if r["conv_id"] != now:
                now, parent, depth = r["conv_id"], ROOT, 0
            role = r["role"] or ""
            segment = format_turn(role, r["text"] or "")
            key = hashlib.blake2b(parent + b"|" + segment.encode(), digest_size=16).digest()
            begin = len("<s>[INST]") + len(escape(role))
            yield (now, depth, parent, key, segment, len(segment), *((begin, len(segment) - len("[/INST]</s>")) if role == "assistant" else (None, None)))
            parent, depth = key, depth + 1

    return _batched(rows(), _STEP)


_PLACE = pa.schema([("key", pa.binary()), ("path", pa.binary()), ("position", pa.int64())])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Path of branch keys and position of the nodes that this conversation owns."""

    def rows() -> Iterator[tuple]:
        now, path, position = object(), b"", 0
        for r in _rows(batches):
            if r["conv_id"] != now:
                now, path, position = r["conv_id"], b"", 0
            if r["branch"]:
                path += r["depth"].to_bytes(4, "big") + r["key"]
            if r["own"]:
                yield r["key"], path, position
            position += r["chars"]

    return _batched(rows(), _PLACE)


_ATTEND = pa.schema([("key", pa.binary()), ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _attends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged stream intervals of the ancestors of the nodes that this conversation owns."""

    def rows() -> Iterator[tuple]:
        now, spans = object(), []
        for r in _rows(batches):
            if r["conv_id"] != now:
                now, spans = r["conv_id"], []
            if r["own"]:
                yield r["key"], [{"start": a, "end": b} for a, b in spans]
            if spans and spans[-1][1] == r["start"]:
                spans[-1] = (spans[-1][0], r["start"] + r["chars"])
            else:
                spans.append((r["start"], r["start"] + r["chars"]))

    return _batched(rows(), _ATTEND)


def prefix_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, paths), both written to the shared folder.

    nodes, in stream order by start: key, parent, depth, start, chars, position, segment (the formatted turn),
    loss_start and loss_end (inside the segment; null without loss), attends (array of start, end).
    paths: conv_id, depth, key of every turn.
    """
    spark = conversations.sparkSession
    given = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    steps = _by_conversation(given, "turn", "role", "text").mapInArrow(_steps, "conv_id long, depth long, parent binary, key binary, segment string, chars long, loss_start long, loss_end long")
    steps = written(steps, "steps", spark)
    owner = steps.groupBy("key").agg(F.min("conv_id").alias("owner"), F.first("parent").alias("parent"))
    owner = written(owner, "owners", spark)
    # first turns all hang on the root and count as branches without a join; hot parents are a skewed join of two tables
    deep = owner.where(F.col("parent") != F.lit(ROOT))
    forks = written(deep.groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select("parent"), "forks", spark)
    marks = deep.join(forks.withColumn("branch", F.lit(True)), "parent", "left").select("key", "owner", F.coalesce("branch", F.lit(False)).alias("branch"))
    marks = marks.unionByName(owner.where(F.col("parent") == F.lit(ROOT)).select("key", "owner", F.lit(True).alias("branch")))
    paths = steps.select("conv_id", "depth", "key", "chars").join(marks, "key").withColumn("own", F.col("conv_id").eqNullSafe(F.col("owner"))).drop("owner")
    paths = written(paths, "paths", spark)
    places = _by_conversation(paths, "depth").mapInArrow(_places, "key binary, path binary, position long").dropDuplicates(["key"])
    nodes = steps.drop("conv_id").dropDuplicates(["key"]).join(places, "key")
    sized = nodes.repartitionByRange(parallelism(spark), "path", "depth").withColumn("part", F.spark_partition_id())
    sized = written(sized, "nodes", spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sized.groupBy("part").agg(F.sum("chars").alias("c")).select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("path", "depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("chars").over(inside), F.lit(0))).join(starts, "part")
    placed = written(placed.select("key", "parent", "depth", (F.col("base") + F.col("inside")).alias("start"), "chars", "position", "segment", "loss_start", "loss_end"), "stream", spark)
    known = paths.select("conv_id", "depth", "key", "chars", "own").join(placed.select("key", "start"), "key")
    attends = _by_conversation(known, "depth").mapInArrow(_attends, "key binary, attends array<struct<start:long,end:long>>").dropDuplicates(["key"])
    return written(placed.join(attends, "key"), "tree", spark), paths.select("conv_id", "depth", "key")


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now, n = None, 0
        for r in _rows(batches):
            if not n or r["conv_id"] != now:
                if n:
                    yield now, n, turns.hexdigest(), loss, masked.hexdigest(), size
                now, n, loss, size, turns, masked = r["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text = parse_turn(r["segment"])
            turns.update(f"{role}\n{text}\n".encode())
            if r["loss_start"] is not None:
                under = unescape(r["segment"][r["loss_start"] : r["loss_end"]])
                masked.update(under.encode())
                loss += len(under)
            n, size = n + 1, size + r["chars"]
        if n:
            yield now, n, turns.hexdigest(), loss, masked.hexdigest(), size

    return _batched(rows(), _READ)


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the output."""
    turns = paths.select("conv_id", "depth", "key").join(nodes.select("key", "segment", "chars", "loss_start", "loss_end"), "key")
    return _by_conversation(turns, "depth").mapInArrow(_digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
