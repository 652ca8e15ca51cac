"""Token-ID files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents in ascending doc_id order, cut into blocks of BLOCK ids. A block is its
minimum, a bit width that holds a chosen share of the offsets from it, the packed low bits, and an exception list
(position, high bits) for the rest. The footer indexes where each block starts, in ids and in bytes, and holds doc_ids
and token counts. Files are written by the tasks into the shared folder through its file system, under a name of the
attempt, and renamed when whole; a manifest row per file carries its totals.

Null texts count as empty: one id, the end id. Null doc_ids come first; doc_ids are whole numbers, as the footer keeps
them so. Repeated rows are separate documents; equal doc_ids follow each other in the order of their texts' hashes. A
very long text is encoded whole in one task. Special tokens written in a text are what the tokenizers library makes of
them by default. Further columns are ignored, whatever their names. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written
from .text import Words, slices, split_words, word_hashes
from .tokens import cuts_at_spaces, default_path, json_encoder, word_rules

MAGIC = b"PFORIDS1"
BLOCK = 1024
SHARE = 0.9
AT_ONCE = 64  # blocks packed together
FILE_BYTES = 24 << 20
MEMO = 600_000
JOINED = 1000  # pieces encoded as one text


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    """One block: minimum, count, width, number of exceptions, low bits, exceptions."""
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    at = np.partition(rest, min(len(rest) - 1, int(share * len(rest))))[min(len(rest) - 1, int(share * len(rest)))]
    width = int(at).bit_length()
    room = 16 if width <= 16 else 32
    bits = np.unpackbits(rest.astype(f">u{room // 8}").view(np.uint8).reshape(-1, room // 8), axis=1)[:, room - width :] if width else np.zeros((len(rest), 0), np.uint8)
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return struct.pack("<IHBxH", low, len(ids), width, len(out)) + np.packbits(bits).tobytes() + out.astype("<u2").tobytes() + (rest[out] >> np.uint32(width)).astype("<u4").tobytes()


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> Iterator[bytes]:
    """pack_block() of each row of a table of blocks that are whole."""
    k, n = ids.shape
    low = ids.min(axis=1)
    rest = (ids - low[:, None]).astype(np.uint32)
    nth = min(n - 1, int(share * n))
    widths = [int(x).bit_length() for x in np.partition(rest, nth, axis=1)[:, nth]]
    if max(widths) > 16:
        yield from (pack_block(x, share) for x in ids)
        return
    bits = np.unpackbits(rest.astype(">u2").view(np.uint8), axis=1).reshape(k, n, 16)
    high = rest >> np.array(widths, np.uint32)[:, None]
    row, place = np.nonzero(high)
    high, place, cut = high[row, place].astype("<u4"), place.astype("<u2"), np.searchsorted(row, np.arange(k + 1)).tolist()
    for i, (least, width) in enumerate(zip(low.tolist(), widths)):
        out = slice(cut[i], cut[i + 1])
        yield struct.pack("<IHBxH", least, n, width, out.stop - out.start) + np.packbits(bits[i, :, 16 - width :]).tobytes() + place[out].tobytes() + high[out].tobytes()


def unpack_block(body: bytes, at: int) -> np.ndarray:
    low, n, width, extra = struct.unpack_from("<IHBxH", body, at)
    at += 10
    size = (n * width + 7) // 8
    full = np.zeros((n, 32), np.uint8)
    if width:
        full[:, 32 - width :] = np.unpackbits(np.frombuffer(body, np.uint8, size, at))[: n * width].reshape(n, width)
    rest = np.packbits(full, axis=1).view(">u4").ravel().astype(np.uint32)
    at += size
    where = np.frombuffer(body, "<u2", extra, at)
    rest[where] |= np.frombuffer(body, "<u4", extra, at + 2 * extra) << np.uint32(width)
    return rest + np.uint32(low)


class Writer:
    """Streams ids into one file; keeps at most one open block and the footer's index."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.left = np.zeros(0, np.uint32)
        self.starts: list[int] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self._write(MAGIC)

    def _write(self, body: bytes) -> None:
        self.out.write(body)
        self.at += len(body)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.ids += doc_ids
        self.counts += counts.tolist()
        self.left = np.concatenate([self.left, ids])
        whole = len(self.left) // BLOCK * BLOCK
        for lo in range(0, whole, AT_ONCE * BLOCK):
            for body in pack_blocks(self.left[lo : min(whole, lo + AT_ONCE * BLOCK)].reshape(-1, BLOCK)):
                self.starts.append(self.at)
                self._write(body)
        self.left = self.left[whole:].copy()

    def close(self) -> int:
        if len(self.left):
            self.starts.append(self.at)
            self._write(pack_block(self.left))
        footer = zlib.compress(json.dumps({"block": BLOCK, "starts": np.diff(self.starts, prepend=0).tolist(), "doc_ids": self.ids, "counts": self.counts}).encode(), 1)
        self._write(footer)
        self._write(struct.pack("<Q", len(footer)) + MAGIC)
        return sum(self.counts)


class Reader:
    """Documents of one file by place; only the blocks that a range of ids touches are unpacked."""

    def __init__(self, body: bytes):
        if body[: len(MAGIC)] != MAGIC or body[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token-id file")
        size = struct.unpack_from("<Q", body, len(body) - 16)[0]
        index = json.loads(zlib.decompress(body[len(body) - 16 - size : len(body) - 16]))
        self.body, self.block = body, index["block"]
        self.starts = np.cumsum(np.array(index["starts"], np.int64))
        self.doc_ids, self.counts = index["doc_ids"], np.array(index["counts"], np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo..hi-1 of the file."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block
        run = np.concatenate([unpack_block(self.body, self.starts[k]) for k in range(a, b + 1)])
        return run[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k] + self.counts[k]))


def _equal(w: Words, other: np.ndarray) -> bool:
    """Is every word equal, byte by byte, to the word that `other` names for it?"""
    size = w.ends - w.starts
    if not np.array_equal(size, size[other]):
        return False
    own = w.places()
    return bool(np.array_equal(w.data[own], w.data[own + np.repeat(w.starts[other] - w.starts, size)]))


_KIND = np.full(256, 4)  # 0: white space, 1: letters, 2: digits, 3: other ASCII, 4: not ASCII
_KIND[:128] = [0 if c in b" \t\n\x0b\x0c\r" else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(128)]
_KIND = _KIND.astype(np.uint8)
_CUT = np.array([[a != b and 0 < a < 4 and 0 < b < 4 for b in range(5)] for a in range(5)]).ravel()


def pieces(w: Words, lower: bool, classes: bool, whole: bytes) -> Words:
    """Parts of words that a tokenizer codes each for itself, A-Z lower-cased in those of ASCII alone.

    A word is cut between two ASCII characters of different kinds; next to others, which may be of any kind or combine,
    it is not. Words with a byte of `whole` stay as they are.
    """
    stop = np.zeros(256, bool)
    stop[list(whole)] = True
    kept = np.zeros(len(w.starts), bool)  # whole words
    at = np.flatnonzero(stop[w.data])
    kept[np.searchsorted(w.starts, at, "right") - 1] = True
    starts, ends = w.starts, w.ends
    if classes and len(w.data):
        kind = _KIND[w.data]
        cut = np.flatnonzero(_CUT[5 * kind[:-1] + kind[1:]]) + 1
        of = np.searchsorted(starts, cut, "right") - 1
        cut = cut[(starts[of] < cut) & ~kept[of]]
        starts, ends = np.sort(np.concatenate([starts, cut]), kind="stable"), np.sort(np.concatenate([ends, cut]), kind="stable")
        kept = kept[np.searchsorted(w.starts, starts, "right") - 1]
    data = w.data
    if lower:
        kept[np.searchsorted(starts, np.flatnonzero(data >= 128), "right") - 1] = True
        upper = np.flatnonzero((data >= 65) & (data <= 90))
        upper = upper[~kept[np.searchsorted(starts, upper, "right") - 1]]
        data = data.copy()
        data[upper] += 32
    return Words(data, w.docs, starts, ends, np.searchsorted(starts, w.docs))


def _taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin there and are so long, one after another."""
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Known:
    """Bytes and ids of pieces in arrays sorted by hash. Of more than `size` pieces the half asked for last stays."""

    def __init__(self, size: int):
        self.size, self.now = size, 0
        self.hash = np.zeros(0, np.uint64)
        self.at, self.long, self.begin, self.count, self.used = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.body, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def turn(self) -> None:
        """Begin a batch."""
        self.now += 1
        if len(self.hash) > self.size:
            keep = np.sort(np.argpartition(-self.used, self.size // 2)[: self.size // 2])
            self.body, self.ids = _taken(self.body, self.at[keep], self.long[keep]), _taken(self.ids, self.begin[keep], self.count[keep])
            self.hash, self.long, self.count, self.used = self.hash[keep], self.long[keep], self.count[keep], self.used[keep]
            self.at, self.begin = np.cumsum(self.long) - self.long, np.cumsum(self.count) - self.count

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands or would stand, and whether it is there."""
        at = np.searchsorted(self.hash, hashes)
        found = at < len(self.hash)
        found[found] = self.hash[at[found]] == hashes[found]
        self.used[at[found]] = self.now
        return at, found

    def add(self, hashes: np.ndarray, long: np.ndarray, body: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(hashes)
        at, begin = len(self.body) + np.cumsum(long) - long, len(self.ids) + np.cumsum(count) - count
        where = np.searchsorted(self.hash, hashes[order])
        self.at, self.long, self.begin, self.count = (np.insert(x, where, y[order]) for x, y in ((self.at, at), (self.long, long), (self.begin, begin), (self.count, count)))
        self.used, self.hash = np.insert(self.used, where, self.now), np.insert(self.hash, where, hashes[order])
        self.body, self.ids = np.concatenate([self.body, body]), np.concatenate([self.ids, ids])


class WordEncoder:
    """Ids of whole texts by the tokenizers library, through a bounded memo of pieces of space-separated words.

    Only for tokenizers that drop white space before their merges; others encode each text whole.
    """

    def __init__(self, path: str, memo: int = MEMO):
        self.encoder, self.by_word, self.memo = json_encoder(path), cuts_at_spaces(path), Known(memo)
        self.rules = word_rules(path) if self.by_word else (False, False, b"")
        self.own = self.rules[0] and self.rules[1]  # a piece a-z goes into the merges as it is

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.by_word:
            return self._whole(column)
        w = split_words(column)
        if not len(w.starts):
            return np.zeros(0, np.uint32), np.zeros(len(w.docs) - 1, np.int64)
        w, memo = pieces(w, *self.rules), self.memo
        key, first, of = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        if not _equal(w, first[of]):  # two pieces with one hash
            return self._whole(column)
        starts, long = w.starts[first], (w.ends - w.starts)[first]
        memo.turn()
        at, old = memo.places(key)
        at = at[old]
        if not np.array_equal(memo.long[at], long[old]) or not np.array_equal(_taken(memo.body, memo.at[at], long[old]), _taken(w.data, starts[old], long[old])):
            return self._whole(column)
        new = np.flatnonzero(~old)
        if len(new):
            body = _taken(w.data, starts[new], long[new])
            memo.add(key[new], long[new], body, *self._coded(body.tobytes(), np.cumsum(long[new])))
        at, _ = memo.places(key)
        size, begin = memo.count[at], memo.begin[at]
        each = size[of]
        ids = _taken(memo.ids, begin[of], each)
        total = np.zeros(len(each) + 1, np.int64)
        np.cumsum(each, out=total[1:])
        return ids, total[w.first[1:]] - total[w.first[:-1]]

    def _whole(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for e in self.encoder.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _coded(self, body: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece of `body`, and all ids."""
        ends = ends.tolist()
        words = [body[a:b] for a, b in zip([0, *ends], ends)]
        ids = [b""] * len(words)
        plain, other = [], []
        for k, x in enumerate(words):
            (plain if self.own and x.isalpha() and x.islower() else other).append(k)
        model = self.encoder.model
        for k in plain:  # as the steps before the merges leave them
            ids[k] = array("I", [t.id for t in model.tokenize(words[k].decode())]).tobytes()
        for lo in range(0, len(other), JOINED):
            part = other[lo : lo + JOINED]
            for k, x in zip(part, self._joined([words[k].decode("utf-8", "replace") for k in part])):
                ids[k] = x
        return np.array([len(x) for x in ids], np.int64) // 4, np.frombuffer(b"".join(ids), np.uint32)

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words from one text with a space between them, cut at the words' offsets."""
        e = self.encoder.encode(" ".join(words), add_special_tokens=False)
        starts = np.array([o[0] for o in e.offsets], np.int64)
        if (np.diff(starts) < 0).any():
            return (array("I", x.ids).tobytes() for x in self.encoder.encode_batch(words, add_special_tokens=False))
        ids = array("I", e.ids).tobytes()
        cut = (4 * np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in words]]))).tolist()
        return (ids[a:b] for a, b in zip(cut[:-1], cut[1:]))


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(counts), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(counts + 1) - 1] = False
    out[keep] = ids
    return out, counts + 1


def _write_files(root: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        name, writer, out, shard = uuid.uuid4().hex, None, None, None
        for batch in slices(batches):
            if writer is None:
                shard = batch.column(2)[0].as_py()
                out = fs.open_output_stream(f"{base}/.{name}")
                writer = Writer(out)
            ids, counts = _with_end(*_encoder(path).batch(batch.column(1)), end)
            writer.add(batch.column(0).to_pylist(), counts, ids)
        if writer is not None:
            total = writer.close()
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}.ids")
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([f"{name}.ids"]), pa.array([total], pa.int64())], names=["shard", "file", "ids"])

    return run


def write_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, root: str | None = None, files: int | None = None) -> DataFrame:
    """Encode and write all documents; the manifest: root, file, shard (files in order), ids, start (ids before it)."""
    spark = docs.sparkSession
    path = path or default_path("word_bpe_49k.json")
    root = root or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if files is None:
        files = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / FILE_BYTES))
    key = F.xxhash64("text")
    ordered = rows.withColumn("key", key).repartitionByRange(files, "doc_id", "key").sortWithinPartitions("doc_id", "key")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard"))
    listed = written(ordered.mapInArrow(_write_files(root, path, end_id), "shard long, file string, ids long"), "manifest", spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return listed.select(F.lit(root).alias("root"), "file", "shard", "ids", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, base = pafs.FileSystem.from_uri(row["root"])
            with fs.open_input_stream(f"{base}/{row['file']}") as f:
                reader = Reader(f.read())
            for k in range(0, len(reader.counts), 2000):
                part = slice(k, k + 2000)
                lo, n = int(reader.first[k]), reader.counts[part]
                ids = reader.ids(lo, lo + int(n.sum())).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.doc_ids[part], pa.int64()), pa.array(reader.first[part] + row["start"]), pa.array(n), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(4 * n)).astype(np.int64)), pa.py_buffer(ids.tobytes())]).cast(pa.binary())],
                    names=["doc_id", "start", "n_tokens", "body"],
                )


def read_ids(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, body (little-endian unsigned 32-bit ids), from the files."""
    spark = manifest.sparkSession
    spread = manifest.repartition(max(1, min(10_000, manifest.count())), "file")
    return spread.mapInArrow(_read_files, "doc_id long, start long, n_tokens long, body binary")
