"""Language-model scoring with a weighted backoff automaton.

n-grams of the training documents (with a start mark before and an end token after each text) are smoothed by a
Dirichlet prior on the next shorter history: p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu), down to the base
p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). As an automaton: a history seen in training is a state, a seen continuation
an arc, and the failure arc to the next shorter history weighs mu / (c(h) + mu). One left-to-right traversal of a text
carries its state and adds up log10 weights.

Nothing needs the whole model in one place. Documents are packed into chunks of bounded size, each written by its task
as a file in the shared folder, so no text passes through a shuffle; a chunk asks for the counts of the n-grams that
its own texts can reach, keyed by hash and dealt into buckets that sum all chunks' training counts; the answers build
the chunk's part of the automaton. A chunk sends rows only to buckets it has n-grams for, so the rows exchanged are at
most the chunks' distinct n-grams. A bucket is a partition by its number, and so are CHUNKS chunks, so no task gets
several of the large ones by chance; each task's part is bounded but for one term: an n-gram found in every chunk gives
its bucket one row of each.

Null texts count as empty: one token, the end. A null doc_id counts as the empty string for the split. Repeated rows
are counted and scored each, and get equal scores; equal probabilities need no tie rule, as a traversal has one path.
A very long text is a chunk of its own and takes about 100 bytes a token. Further columns are ignored, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import shared_dir, written
from .text import U, coefficients, lean, mix, slices, split_words, word_hashes

ORDER = 2
MU = 4.0
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20
CHUNKS = 4  # of a task
WALK = 1 << 14  # places of a traversal that are Python numbers at a time
FOLDS, HELD_OUT = 5, 1
END = mix(np.array([0x454E44], U))[0]
START = mix(np.array([0x425547], U))[0]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, the end token after each, and the first place of each text (and the end)."""
    w = split_words(column)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, U)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = word_hashes(w, lower=True)
    return out, first


def _grams(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the key of the n-gram that ends at each place, START standing before each text."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out = [tokens]
    for n in range(2, order + 1):
        r = coefficients(n, 104_729 + n)
        key = tokens * r[0]
        for j in range(1, n):
            past = np.full(len(tokens), START, U)
            ok = place >= j
            past[ok] = tokens[np.flatnonzero(ok) - j]
            key += past * r[j]
        out.append(mix(key))
    return out


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Places where sorted keys pass from bucket to bucket."""
    edges = np.array([k * (1 << 64) // buckets for k in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _packed(values: np.ndarray) -> bytes:
    """Byte planes, the highest first: those of small numbers are mostly zeros and compress."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T[::-1].tobytes()


def _unpacked(body: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, -1)[::-1].T).view(kind).ravel()


def _chunked(root: str):
    """One row a chunk: the file with its documents as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        for batch in slices(batches, "text", CHUNK_BYTES):
            name = uuid.uuid4().hex
            with fs.open_output_stream(f"{base}/{name}") as sink, pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["file"])

    return run


def _unchunked(root: str, name: str) -> pa.Table:
    fs, base = pafs.FileSystem.from_uri(root)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return pa.ipc.open_stream(f).read_all().combine_chunks()


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Rows of equal keys, of batches sorted by them; one group is held at a time."""
    held, last = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
        lo = 0
        for hi in range(1, len(keys) + 1):
            if hi == len(keys) or keys[hi] != keys[lo]:
                if held and keys[lo] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last, lo = keys[lo], hi
    if held:
        yield pa.Table.from_batches(held)


def _asked(root: str, order: int, buckets: int):
    def rows(number: int, chunk: pa.Table) -> Iterator[tuple]:
        tokens, first = _tokens(chunk.column("text").combine_chunks())
        train = np.repeat(~chunk.column("held_out").to_numpy(), np.diff(first))
        for n, g in enumerate(_grams(tokens, first, order), 1):
            keys, at = np.unique(g, return_inverse=True)
            counts = np.bincount(at[train], minlength=len(keys)).astype(np.uint32)  # of one chunk
            cut = _cuts(keys, buckets)
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                yield number, n, int(b), _packed(np.diff(keys[part], prepend=U(0))), _packed(counts[part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, name in zip(batch.column(0), batch.column(1)):
                found = list(rows(number.as_py(), _unchunked(root, name.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _ASKED.types)], schema=_ASKED)

    return run


_ASKED = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _summed(rows: pa.Table) -> pa.Table:
    """All chunks' questions of one bucket and order: the sums, dealt back; and the totals, as chunk -1."""
    keys = [np.cumsum(_unpacked(x.as_buffer(), U), dtype=U) for x in rows.column("keys")]
    counts = np.concatenate([_unpacked(x.as_buffer(), np.uint32) for x in rows.column("counts")])
    size = np.cumsum([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    sums = np.zeros(len(distinct), U)
    np.add.at(sums, at, counts)
    answers = [_packed(sums[x]) for x in np.split(at, size[:-1])]
    n, b = rows.column("n")[0].as_py(), rows.column("bucket")[0].as_py()
    more = len(answers) + 1
    return pa.table({
        "chunk": pa.array([*rows.column("chunk").to_pylist(), -1], pa.int64()), "n": pa.array([n] * more, pa.int32()), "bucket": pa.array([b] * more, pa.int32()),
        "counts": pa.array([*answers, b""], pa.binary()), "total": pa.array([0] * (more - 1) + [int(sums.sum())], pa.int64()), "kinds": pa.array([0] * (more - 1) + [int((sums > 0).sum())], pa.int64()),
    })


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "bucket", "n"):
        yield from _summed(rows).to_batches()


def _traverse(arcs: list[np.ndarray], failures: list[np.ndarray], states: list[np.ndarray], lo: int, hi: int) -> float:
    """Score of places lo..hi-1, one walk from left to right. arcs[n][i]: weight of the arc on token i from the history
    of n tokens, NaN for none; failures[n][i]: weight of that history's failure arc; states[n][i]: are the n tokens up
    to i a state?"""
    top, total = len(arcs) - 1, 0.0
    n = top  # the start's history is a state
    for at in range(lo, hi, WALK):
        part = slice(at, min(hi, at + WALK))
        arc, failure, state = ([x[part].tolist() for x in given] for given in (arcs, failures, states))
        for i in range(part.stop - at):
            weight = arc[n][i]
            while weight != weight:
                total += failure[n][i]
                n -= 1
                weight = arc[n][i]
            total += weight
            if n < top:
                n += 1
            while n and not state[n][i]:
                n -= 1
    return total


_SCORED = pa.schema([("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scored(root: str, order: int, mu: float, tokens_in_training: int, kinds: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), *_SCORED])

    def one(answers: pa.Table) -> pa.Table:
        """Rows of one chunk by n and bucket; the first, of n = 0, names its file."""
        chunk = _unchunked(root, answers.column("counts")[0].as_py().decode())
        tokens, first = _tokens(chunk.column("text").combine_chunks())
        count = []  # of the n-gram that ends at each place
        for n, g in enumerate(_grams(tokens, first, order), 1):
            _, at = np.unique(g, return_inverse=True)
            count.append(np.concatenate([_unpacked(c.as_buffer(), U) for m, c in zip(answers.column("n").to_pylist(), answers.column("counts")) if m == n])[at].astype(np.float64))
        p = (count[0] + 0.5) / (tokens_in_training + 0.5 * (kinds + 1))
        base = np.log10(p)
        arcs, failures, states = [base], [np.zeros(0)], [np.zeros(0, bool)]
        place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
        inner = np.flatnonzero(place >= 1)
        documents = count[0][first[1] - 1]  # as many ends as training documents
        for n in range(1, order):
            history = np.full(len(tokens), documents)  # count of the n tokens before; START alone: every document
            history[inner] = count[n - 1][inner - 1]
            p = np.where(history > 0, (count[n] + mu * p) / (history + mu), p)
            arcs.append(np.where(count[n] > 0, np.log10(p), np.nan))
            failures.append(np.log10(mu / (history + mu)))
            states.append(count[n - 1] > 0)
        known, starts = count[0] > 0, first[:-1]
        del count, p, place, inner
        scores = [_traverse(arcs, failures, states, a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        return pa.Table.from_arrays([
            chunk.column("doc_id").combine_chunks(), chunk.column("held_out").combine_chunks(), pa.array(np.diff(first).astype(np.int64)),
            pa.array(np.add.reduceat(known, starts, dtype=np.int64)), pa.array(np.add.reduceat(base, starts)), pa.array(scores, pa.float64()),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for answers in _groups(batches, "chunk"):
            yield from one(answers).to_batches()

    return run


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: float = MU) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    root = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    files = written(rows.mapInArrow(lean(_chunked(root)), "file string"), "chunks", spark)
    parts = max(1, math.ceil(files.count() / CHUNKS))
    chunks = files.select((F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("chunk"), "file")  # one row a chunk
    own = (F.col("chunk") % parts).cast("int")
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    asked = chunks.repartitionById(parts, own).mapInArrow(lean(_asked(root, order, buckets)), "chunk long, n int, bucket int, keys binary, counts binary")
    answers = asked.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "n").mapInArrow(lean(_sums), "chunk long, n int, bucket int, counts binary, total long, kinds long")
    answers = written(answers, "counts", spark)
    total = answers.where("chunk = -1 and n = 1").agg(F.sum("total"), F.sum("kinds")).first()
    n, v = total[0] or 0, total[1] or 0
    kind = rows.schema["doc_id"].dataType
    named = chunks.select("chunk", F.lit(0).alias("n"), F.lit(0).alias("bucket"), F.col("file").cast("binary").alias("counts"))
    dealt = answers.where("chunk >= 0").select("chunk", "n", "bucket", "counts").unionByName(named).repartitionById(parts, own)
    scored = dealt.sortWithinPartitions("chunk", "n", "bucket").mapInArrow(
        lean(_scored(root, order, mu, n, v, to_arrow_type(kind))), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
