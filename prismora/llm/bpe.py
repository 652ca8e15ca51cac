"""Byte-level BPE encoding and decoding in DuckDB, by ranks.

A text is split by the pattern; each distinct piece of a batch becomes token-position rows. A recursive query joins
adjacent rows to the merge table and contracts each word's leftmost minimum-rank pair until nothing merges; ordered
aggregation turns ids back into bytes. The query holds every step of every piece, which grows with the square of a
piece's length, so pieces go to it in groups of bounded squares. Pieces over LONG bytes are contracted in the same
order from a heap, as one contraction a step is quadratic there. A memo of bounded size keeps frequent pieces.

Null texts count as empty and have no ids; repeated rows get equal ids; of equal ranks in a piece the leftmost goes
first; a very long text is coded a stretch of pieces at a time; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import HELD, lean, slices
from .tokens import Memo, default_path, default_pattern, ranks

LONG = 64
MEMO = 350_000
SQUARES = 2_000_000  # sum of the squared lengths of the pieces in one query
IDS = 400_000  # ids of the pieces that one query decodes
STRETCH = 200_000  # pieces of a text that are coded at once

_ENCODE = """
with recursive run as (
    select w.word, p.pos, v.id, 0 as step
    from words w, lateral (select unnest(range(octet_length(w.body))) as pos) p
    join bytes v on v.body = substr(w.hex, 2 * p.pos::int + 1, 2)
    union all
    (
        with best as (
            select r.word, min((m.rank::bigint << 16) | (r.pos << 8) | r.next) as pick
            from (select word, pos, id, lead(id) over w as after, lead(pos) over w as next from run window w as (partition by word order by pos)) r
            join merges m on m.a = r.id and m.b = r.after
            group by r.word
        )
        select r.word, r.pos, case when r.pos = (b.pick >> 8) & 255 then (b.pick >> 16)::int else r.id end, r.step + 1
        from run r join best b using (word) where r.pos <> b.pick & 255
    )
)
select word, list(id order by pos) as ids
from run join (select word, max(step) as step from run group by word) using (word, step) group by word
"""
_DECODE = """
select s.word, string_agg(v.hex, '' order by s.pos) as hex
from (select word, unnest(ids) as id, generate_subscripts(ids, 1) as pos from coded) s join vocabulary v using (id)
group by s.word
"""


#: Of pieces: their ids joined by a space, with the decoded bytes where these are not the piece's own; and the pieces.
Stretch = tuple[list[str | tuple[str, bytes]], list[str]]


def _pair(value: str | tuple[str, bytes], piece: str) -> tuple[str, bytes]:
    return (value, piece.encode("utf-8", "surrogatepass")) if isinstance(value, str) else value


def _joined(values: list[str | tuple[str, bytes]], pieces: list[str]) -> tuple[str, bytes]:
    """Ids of a stretch joined by a space, and its decoded bytes."""
    if set(map(type, values)) <= {str}:
        return " ".join(values), "".join(pieces).encode("utf-8", "surrogatepass")
    pairs = [_pair(v, w) for v, w in zip(values, pieces)]
    return " ".join([p[0] for p in pairs]), b"".join([p[1] for p in pairs])


class Coder:
    """Encodes and decodes with one DuckDB connection in this process."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.table = ranks(path)
        self.split = regex.compile(pattern).finditer
        self.memo = Memo(memo)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(self.table[t[:k]], self.table[t[k:]], r) for t, r in self.table.items() for k in range(1, len(t)) if t[:k] in self.table and t[k:] in self.table]
        a, b, rank = zip(*pairs) if pairs else ((), (), ())
        self._put("merges", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()), rank=pa.array(rank, pa.int32()))
        self._put("vocabulary", id=pa.array(self.table.values(), pa.int32()), hex=pa.array([t.hex() for t in self.table]))
        one = [t for t in self.table if len(t) == 1]
        self._put("bytes", body=pa.array([t.hex() for t in one]), id=pa.array([self.table[t] for t in one], pa.int32()))

    def _put(self, name: str, **columns: pa.Array) -> None:
        given = pa.table(columns)  # noqa: F841  read by name
        self.db.execute(f"create or replace table {name} as select * from given")

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        short = []
        for k, w in enumerate(words):
            if w in self.table:  # a word that is a token is not contracted
                out[k] = [self.table[w]]
            elif len(w) > LONG:
                out[k] = _contract(w, self.table)
            elif w:
                short.append(k)
        short.sort(key=lambda k: len(words[k]))
        while short:
            ends = np.cumsum([len(words[k]) ** 2 for k in short])
            group = short[: max(1, int(np.searchsorted(ends, SQUARES, "right")))]
            short = short[len(group) :]
            self._put("words", word=pa.array(group, pa.int32()), body=pa.array([words[k] for k in group], pa.binary()), hex=pa.array([words[k].hex() for k in group]))
            for k, ids in self.db.execute(_ENCODE).fetchall():
                out[k] = ids
        return out

    def decode_words(self, ids: list[list[int]]) -> list[bytes]:
        out = [b""] * len(ids)
        full = [k for k, x in enumerate(ids) if x]
        while full:
            ends = np.cumsum([len(ids[k]) for k in full])
            group = full[: max(1, int(np.searchsorted(ends, IDS, "right")))]
            full = full[len(group) :]
            self._put("coded", word=pa.array(group, pa.int32()), ids=pa.array([ids[k] for k in group], pa.list_(pa.int32())))
            for k, text in self.db.execute(_DECODE).fetchall():
                out[k] = bytes.fromhex(text)
        return out

    def batch(self, texts: list[str]) -> Iterator[list[tuple[str, bytes]]]:
        """For each text, its pieces' (ids joined by a space, decoded bytes)."""
        for parts in self.stretched(texts):
            yield [_pair(v, w) for values, pieces in parts for v, w in zip(values, pieces)]

    def stretched(self, texts: list[str]) -> Iterator[Iterator[Stretch]]:
        """For each text, stretches of at most STRETCH pieces: what the memo has of them, and the pieces. A text's
        stretches are to be used up before the next text's."""
        stretches = ((k, part) for k, t in enumerate(texts) for part in self._stretches(t))
        held: list[tuple[int, list[str]]] = []
        coded = self._coded(stretches, held)
        for _, parts in itertools.groupby(coded, key=lambda x: x[0]):
            yield (p for _, p in parts)

    def _stretches(self, text: str) -> Iterator[list[str]]:
        pieces = (m[0] for m in self.split(text))
        while part := list(itertools.islice(pieces, STRETCH)):
            yield part
            if len(part) < STRETCH:
                return
        yield []

    def _coded(self, stretches: Iterator[tuple[int, list[str]]], held: list) -> Iterator[tuple[int, Stretch]]:
        """Code stretches together until they have STRETCH pieces, so that small texts share a query."""
        size = 0
        for k, part in itertools.chain(stretches, [(-1, [])]):
            held.append((k, part))
            size += len(part)
            if size < STRETCH and k >= 0:
                continue
            new = self.memo.missing(set(itertools.chain.from_iterable(p for _, p in held)))
            if new:
                coded = self.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
                for w, ids, body in zip(new, coded, self.decode_words(coded)):
                    line = " ".join(map(str, ids))
                    self.memo[w] = line if body == w.encode("utf-8", "surrogatepass") else (line, body)
                del new, coded
            known = self.memo
            for own, pieces in held:
                if own >= 0:
                    yield own, ([known[w] for w in pieces], pieces)
            held.clear()
            size = 0


def _contract(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same contraction order as the query, for one long word: leftmost pair of the least rank first."""
    n = len(word)
    begin, after, before = list(range(n)), [*range(1, n), -1], [-1, *range(n - 1)]
    part: list[bytes | None] = [word[k : k + 1] for k in range(n)]
    heap = [(r, k) for k in range(n - 1) if (r := table.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        nxt = after[k]
        if part[k] is None or nxt < 0 or table.get(part[k] + part[nxt]) != r:
            continue
        part[k], part[nxt] = part[k] + part[nxt], None
        after[k] = after[nxt]
        if after[nxt] >= 0:
            before[after[nxt]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] >= 0 and (r := table.get(part[left] + part[after[left]])) is not None:
                heapq.heappush(heap, (r, left))
    return [table[part[k]] for k in begin if part[k] is not None]


_coders: dict[tuple[str, str], Coder] = {}
HELD["bpe"] = _coders.clear


def coder(path: str, pattern: str) -> Coder:
    """One coder per worker process."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def _digests(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts, ids, bodies = [], [], []
            for stretches in coder(path, pattern).stretched(texts):
                n, line, body = 0, hashlib.sha256(), hashlib.sha256()
                for values, pieces in stretches:
                    if values:
                        text, part = _joined(values, pieces)
                        line.update((" " + text if n else text).encode())
                        n += text.count(" ") + 1
                        body.update(part)
                counts.append(n), ids.append(line.hexdigest()), bodies.append(body.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(bodies, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [[int(x) for values, pieces in stretches for x in _joined(values, pieces)[0].split()] for stretches in coder(path, pattern).stretched(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                bodies = coder(path, pattern).decode_words([x or [] for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bodies, pa.binary())], names=["doc_id", "body"])

    return run


def _map(df: DataFrame, id_col: str, col: str, run, more: str, name: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(col).alias(name))
    return rows.mapInArrow(lean(run, "bpe"), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {more}")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return _map(docs, id_col, text_col, _encoded(path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()), "ids array<int>", "text")


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and body (bytes) of every row of ids; null ids decode to no bytes."""
    return _map(coded, id_col, ids_col, _decoded(path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern()), "body binary", "ids")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and decoded again."""
    run = _digests(path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern())
    return _map(docs, id_col, text_col, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", "text")
