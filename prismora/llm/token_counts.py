"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, whole; tokens become byte spans (and, at section bounds, code points), and an interval
join of the ordered spans with the ordered sections attributes each token. A token that crosses a bound goes, by
`rule`, to the section of its first byte ("first"), of its last byte ("last"), or of most of its bytes, the earlier of
equals ("most").

Sections are the lines of a text, or the fields of a row joined by a separator that belongs to the field before it.
Null texts and fields count as empty: an empty document has one empty section without tokens. Repeated rows are
counted each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import slices
from .tokens import default_path, default_pattern, rank_encoder, ranks


def attribute(token_ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of tokens with sections, both in order: (tokens of each section, those that cross its end).

    token_ends: end of each token, the first starts at 0; bounds: start of each section, ascending from 0.
    """
    starts = np.append(0, token_ends[:-1]).astype(np.int64)[: len(token_ends)]
    a = np.searchsorted(bounds, starts, "right") - 1
    b = np.searchsorted(bounds, token_ends - 1, "right") - 1
    crossing = a != b
    owner = b.copy() if rule == "last" else a.copy()
    if rule == "most":
        for k in np.flatnonzero(crossing):
            cuts = np.concatenate([[starts[k]], bounds[a[k] + 1 : b[k] + 1], [token_ends[k]]])
            owner[k] = a[k] + int(np.argmax(np.diff(cuts)))
    elif rule not in ("first", "last"):
        raise ValueError(f"unknown rule {rule}")
    n = len(bounds)
    return np.bincount(owner, minlength=n), np.bincount(a[crossing], minlength=n)


def _counted(path: str, pattern: str, rule: str, many: bool):
    """many: the sections are given as an array of texts; else they are the lines of one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(path, pattern)
        table = ranks(path)
        width = np.zeros(max(table.values()) + 1, np.int64)
        width[list(table.values())] = [len(t) for t in table]
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            fields = batch.column(2).to_pylist() if many else None
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                body = np.frombuffer(text.encode(), np.uint8)
                if many:
                    sizes = [len((f or "").encode()) for f in fields[k] or [""]]
                    bounds = np.cumsum([0, *sizes[:-1]])
                else:
                    bounds = np.append(0, np.flatnonzero(body == 10) + 1)
                ends = np.cumsum(width[encoder.encode_to_numpy(text, disallowed_special=())])
                n, cross = attribute(ends, bounds, rule)
                chars = np.append(0, np.cumsum(body & 0xC0 != 0x80))[np.append(bounds, len(body))]
                out[0].append(np.full(len(bounds), k))
                out[1].append(np.arange(len(bounds)))
                out[2].append(chars[:-1])
                out[3].append(chars[1:])
                out[4].append(n)
                out[5].append(cross)
            cols = [np.concatenate(c).astype(np.int64) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *map(pa.array, cols[1:])], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return run


_COLUMNS = "section long, start long, end long, n_tokens long, n_crossing long"


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "first", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per line of each text: doc_id, section, start, end (code points, with the line's \\n), n_tokens, n_crossing."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = _counted(path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern(), rule, False)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")


def field_counts(docs: DataFrame, fields: list[str], separator: str = "\n", id_col: str = "doc_id", rule: str = "first", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per field of each row, the row encoded whole as its fields with the separator after each but the last."""
    given = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    given = [F.concat(c, F.lit(separator)) if k + 1 < len(given) else c for k, c in enumerate(given)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array(*given).alias("parts")).select("doc_id", F.concat_ws("", "parts").alias("text"), "parts")
    run = _counted(path or default_path("byte_bpe_50k.tiktoken"), pattern or default_pattern(), rule, True)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")
