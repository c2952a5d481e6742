"""Token counts of the sections of a document, from one encoding of the whole.

The document is encoded once; each token's character span, from its bytes, meets the sections' spans in
an interval join over two sorted lists.  Sections are paragraphs, that is lines with their line
break.  A token that crosses a boundary goes, under rule "majority", to the section with most of its bytes (ties to
the earlier), under "first" to the one it begins in; "split" counts for each section its share of the token.

Defined cases: a null or empty text has no sections and no rows (encode() gives null ids for a null text, no ids for an empty one); a
blank text is one section for each of its lines; very long texts are encoded whole; repeated rows are counted each by itself; of sections
with equal shares of a token the earlier has it.  doc_id may be null or of any type; other columns, whatever their names, have no influence;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe as B
from . import textkit as K

RULES = ("majority", "first", "split")


def sections(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all sections, and each document's first section (one more at the end)."""
    start = np.zeros(len(buf) + 1, bool)
    start[off] = True
    start[np.flatnonzero(buf == 10) + 1] = True
    at = np.flatnonzero(start[: len(buf)])
    return at, np.searchsorted(at, off)


def attribute(end: np.ndarray, size: np.ndarray, bound: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section and how many of those cross a boundary.

    end, size: of all tokens, in bytes; bound: first bytes of all sections.
    """
    start = end - size
    a = np.searchsorted(bound, start, "right") - 1
    z = np.searchsorted(bound, end - 1, "right") - 1
    n = len(bound)
    limit = np.append(bound[1:], end[-1] if len(end) else 0)
    inside = a == z
    count = np.bincount(a[inside], minlength=n).astype(float)
    cross = np.zeros(n)
    for i in np.flatnonzero(~inside):
        parts = np.arange(a[i], z[i] + 1)
        share = np.minimum(limit[parts], end[i]) - np.maximum(bound[parts], start[i])
        if rule == "split":
            count[parts] += share / size[i]
            cross[parts] += 1
        else:
            to = a[i] if rule == "first" else parts[np.argmax(share)]
            count[to] += 1
            cross[to] += 1
    return count, cross


def section_tokens(docs: DataFrame, rule: str = "majority", tokenizer: str = B.TOKENIZER) -> DataFrame:
    """One row a section: doc_id, section, its characters [start, end), n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    docs = docs.select("doc_id", "text")
    vocabulary = docs.sparkSession.sparkContext.broadcast(B.Bpe.load(tokenizer))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = B.encoder(vocabulary.value, tokenizer)
        for b in K.chunks(batches):
            buf, off = K.text_bytes(b.column(1))
            if not len(buf):
                continue
            ids, _ = enc.encode_bytes(buf, off)
            size = enc.bpe.length[ids]
            bound, first = sections(buf, off)
            count, cross = attribute(np.cumsum(size), size, bound, rule)
            chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            row = np.repeat(np.arange(b.num_rows), np.diff(first))
            base = chars[off[row]]
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(row)),
                    pa.array(np.arange(len(row)) - first[row], pa.int32()),
                    pa.array(chars[bound] - base, pa.int32()),
                    pa.array(chars[np.append(bound[1:], len(buf))] - base, pa.int32()),
                    pa.array(count),
                    pa.array(cross.astype(np.int32)),
                ],
                ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, section int, start int, end int, n_tokens double, n_crossing int")


def encode(docs: DataFrame, tokenizer: str = B.TOKENIZER) -> DataFrame:
    """One row a document: doc_id, ids, n_tokens, n_bytes, and whether decoding gives the text's very bytes.

    A null text gives null ids, an empty one no ids.
    """
    docs = docs.select("doc_id", "text")
    vocabulary = docs.sparkSession.sparkContext.broadcast(B.Bpe.load(tokenizer))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = B.encoder(vocabulary.value, tokenizer)
        for b in K.chunks(batches):
            buf, off = K.text_bytes(b.column(1))
            ids, first = enc.encode_bytes(buf, off)
            same = enc.bpe.round_trips(ids, first, buf, off)
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(null))
            mask = lambda x: pa.array(x, mask=null)
            yield pa.record_batch(
                [b.column(0), lists, mask(np.diff(first)), mask(np.diff(off)), mask(same)],
                ["doc_id", "ids", "n_tokens", "n_bytes", "round_trip"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, n_bytes long, round_trip boolean")
