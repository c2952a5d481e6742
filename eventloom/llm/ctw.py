"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions.  Each has a context tree over the preceding DEPTH bytes; a
node's Krichevsky-Trofimov estimate is mixed, half and half, with the product of its children's
mixtures, at all depths.  A document's score is its code length in bits for each byte.  score_corpus() takes each byte out of the counts
before it is coded: KT estimates don't depend on order, so this is what the trees of all other bytes of the corpus would say of it, and a text that
stands once in the corpus does not explain itself.  score() codes other documents under the trees of a corpus.

A code length depends on a byte and its DEPTH predecessors only, so each distinct string of DEPTH + 1 bytes (a gram) is weighed once.
Documents are dealt by hash into chunks of about CHUNK_BYTES, of each of which the grams and their counts are gathered; what is
gathered grows with the corpus.  Grams then meet by their last two context bytes, in as many parts as the corpus asks for: a part has whole subtrees,
which are weighed level by level with numpy.  Only sums for each last byte (256 rows at most) go through the driver, for the two top levels.
The code lengths of a chunk's grams go back to the chunk, which scores its documents.  No table of all grams is held anywhere, and every text is
read twice, whatever the number of parts.

Defined cases: a null or empty text has no bytes and a null score, and counts nothing; before a text's first byte
stand zero bytes; very long texts are read whole; repeated rows have a row each and count each.  doc_id may be null, repeated or of any type; other
columns, whatever their names, have no influence; equal texts have equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

DEPTH, CHUNK_BYTES, PART_BYTES, COUNT_BYTES = 6, 24 << 20, 16 << 20, 1 << 20


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0, by Stirling's series after a shift by eight."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 12
        shift -= np.where(small, np.log(np.where(small, y, 1)), 0)
        y = np.where(small, y + 1, y)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series


def kt_log(n: np.ndarray) -> np.ndarray:
    """log of the KT block probability; the last axis holds the counts of zeros and ones."""
    return lgamma(n[..., 0] + 0.5) + lgamma(n[..., 1] + 0.5) - lgamma(n[..., 0] + n[..., 1] + 1) - math.log(math.pi)


def bit_counts(counts: np.ndarray) -> np.ndarray:
    """[..., 256] byte counts to [..., 255, 2] counts at the decisions, in order of their prefixes."""
    parts = []
    for k in range(8):
        c = counts.reshape(*counts.shape[:-1], 1 << k, 2, 128 >> k).sum(-1)
        parts.append(c)
    return np.concatenate(parts, axis=-2)


def contexts(buf: np.ndarray, off: np.ndarray, depth: int = DEPTH, kind: type = np.int64) -> np.ndarray:
    """Of each byte the preceding depth bytes, the last one highest; zeros before a document's start."""
    out = np.zeros(len(buf), kind)
    start = off[:-1][np.diff(off) > 0]
    for d in range(1, depth + 1):
        b = np.zeros(len(buf), kind)
        b[d:] = buf[:-d]
        for e in range(d):
            at = start + e
            b[at[at < len(buf)]] = 0
        out |= b << kind(8 * (depth - d))
    return out


def packed(x: np.ndarray) -> bytes:
    """Bytes of an array, those of one place in the numbers together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


def of_bytes(buf: np.ndarray, off: np.ndarray, depth: int) -> np.ndarray:
    """The gram of each byte."""
    return contexts(buf, off, depth) << 8 | buf


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(x, prepend=x[:1] - 1))


def grams(texts: Iterable[pa.RecordBatch], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the texts in order, and their counts; COUNT_BYTES are sorted at a time, and merged as they come to be as many as are held."""
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    more: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return summed(*(np.concatenate(x) for x in zip((keys, n), *more)))

    for b in K.chunks(iter(texts), COUNT_BYTES):
        g = of_bytes(*K.text_bytes(b.column(b.schema.get_field_index("text"))), depth)
        g.sort()
        first = _firsts(g)
        more.append((g[first], np.diff(np.append(first, len(g)))))
        if sum(len(k) for k, _ in more) > max(len(keys), 1 << 20):
            (keys, n), more = merged(), []
    return merged()


def _nodes(key: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each node of the k-th decision, and each row's node; rows are in order of context, then byte."""
    new = np.diff(key >> (8 - k), prepend=-1) != 0
    return np.flatnonzero(new), np.cumsum(new) - 1


def weigh(gram: np.ndarray, n: np.ndarray, depth: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The subtrees below two context bytes, of all grams that end in them, in order.

    Returns the probability of each gram's eight decisions [8, grams] after mixing at the depths from 2 on; and of depth 2 the rows
    (context and byte), their counts, and log Pw of the nodes of each decision.
    """
    levels = [(gram, n.astype(np.float64), None)]
    while len(levels) < depth - 1:
        key, count, _ = levels[-1]
        up_key, up = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
        levels.append((up_key, np.bincount(up, weights=count), up))
    probability, tops = np.empty((8, len(gram))), []
    for k in range(8):
        one = (gram >> (7 - k) & 1).astype(bool)
        path = np.arange(len(gram))
        r = log_pw = first = None
        for key, count, up in levels:
            below_first = first
            first, node = _nodes(key, k)
            ones = np.add.reduceat(count * (key >> (7 - k) & 1), first)
            total = np.add.reduceat(count, first)
            own = kt_log(np.stack([total - ones, ones], -1))
            if up is not None:
                path = up[path]
                below = np.bincount(node[up[below_first]], weights=log_pw, minlength=len(first))
                weight = 1 / (1 + np.exp(-np.clip(own - below, -700, 700)))
                log_pw = np.logaddexp(own, below) - math.log(2)
            else:
                log_pw = own
            at = node[path]
            mine = np.where(one, ones[at], total[at] - ones[at])
            a = (mine - 0.5) / total[at] if leave_out else (mine + 0.5) / (total[at] + 1)
            r = a if up is None else mixed(weight[at], a, r, leave_out)
        probability[k] = r
        tops.append(log_pw)
    return probability, *levels[-1][:2], tops


def mixed(w: np.ndarray, own: np.ndarray, below: np.ndarray, leave_out: bool) -> np.ndarray:
    """The node's probability from its own estimate and that of the node below it.

    w is the weight with all bytes counted: to take the byte out, its probabilities divide what they were a part of.
    """
    return 1 / (w / own + (1 - w) / below) if leave_out else w * own + (1 - w) * below


def _top_sums(key: np.ndarray, n: np.ndarray, tops: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last bytes, counts [, 256], sums of log Pw [, 255]) of the rows of depth 2."""
    last, inverse = np.unique(key >> 16, return_inverse=True)
    counts, below = np.zeros((len(last), 256)), np.zeros((len(last), 255))
    np.add.at(counts, (inverse, key & 255), n)
    for k, log_pw in enumerate(tops):
        first, _ = _nodes(key, k)
        np.add.at(below, (inverse[first], (1 << k) - 1 + ((key[first] & 255) >> (8 - k))), log_pw)
    return last, counts, below


class Top:
    """The nodes of depth 0 and 1: counts and weights, by last byte and node."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        counts, below = np.zeros((256, 256)), np.zeros((256, 255))
        for last, c, b in rows:
            counts[last], below[last] = c, b
        self.counts = [bit_counts(counts.sum(0))[None], bit_counts(counts)]
        own = kt_log(self.counts[1])
        root = kt_log(self.counts[0][0]) - (np.logaddexp(own, below) - math.log(2))[counts.any(1)].sum(0)
        self.weights = [1 / (1 + np.exp(-np.clip(x, -700, 700))) for x in (root[None], own - below)]

    def code_lengths(self, gram: np.ndarray, probability: np.ndarray, depth: int, leave_out: bool) -> np.ndarray:
        """Bits of each gram's last byte, from its decisions' probabilities at depth 2."""
        byte, last = gram & 255, gram >> (8 * depth)
        bits = np.zeros(len(gram))
        for k in range(8):
            node, one = (1 << k) - 1 + (byte >> (8 - k)), byte >> (7 - k) & 1
            p = probability[k]
            for d, row in ((1, last), (0, np.zeros_like(last))):
                mine, total = self.counts[d][row, node, one], self.counts[d][row, node].sum(-1)
                a = (mine - 0.5) / total if leave_out else (mine + 0.5) / (total + 1)
                p = mixed(self.weights[d][row, node], a, p, leave_out)
            bits -= np.log2(p)
        return bits


# Spark side


def _pieces(docs: DataFrame, size: int, each: int) -> int:
    """How many pieces of about `each` bytes; of a small corpus one for each core."""
    return max(1, -(-size // each), min(docs.sparkSession.sparkContext.defaultParallelism, size >> 20))


def _chunked(docs: DataFrame, size: int) -> DataFrame:
    """docs by chunk, in tasks of a few chunks."""
    chunks = _pieces(docs, size, CHUNK_BYTES)
    return K.spread(docs.withColumn("__el_chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), size, "__el_chunk")


def _size(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def gather(chunked: DataFrame, parts: int, depth: int) -> DataFrame:
    """Grams of each chunk by part: (chunk, part, grams, n), packed."""

    def run(table: pa.Table) -> pa.Table:
        gram, n = grams(table.to_batches(), depth)
        part = (K.mix((gram >> (8 * (depth - 1))).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, cut = np.unique(part[order], return_index=True)
        spans = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)])]
        return pa.table(
            {
                "chunk": pa.array([table["__el_chunk"][0].as_py()] * len(part), pa.int32()),
                "part": pa.array(part, pa.int32()),
                "grams": pa.array([packed(np.diff(gram[i], prepend=0)) for i in spans], pa.binary()),
                "n": pa.array([packed(n[i].astype(np.uint32)) for i in spans], pa.binary()),
            }
        )

    texts = chunked.where("text <> ''").select("__el_chunk", "text")
    return texts.groupBy("__el_chunk").applyInArrow(run, "chunk int, part int, grams binary, n binary")


def train(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The grams of a corpus, written to the shared folder: (chunk, part, grams, n, parts)."""
    docs = docs.select("doc_id", "text")
    size = _size(docs)
    parts = _pieces(docs, size, PART_BYTES)
    return K.materialize(gather(_chunked(docs, size), parts, depth).withColumn("parts", F.lit(parts)), "ctw-grams")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Grams of a part and their counts over all chunks; and the grams of each row."""
    each = [np.cumsum(unpacked(x, np.int64)) for x in table["grams"].to_pylist()]
    n = [unpacked(x, np.uint32).astype(np.int64) if x is not None else np.zeros(len(g), np.int64) for x, g in zip(table["n"].to_pylist(), each)]
    return *summed(np.concatenate(each), np.concatenate(n)), each


def _top(counted: DataFrame, depth: int) -> Top:
    def sums(table: pa.Table) -> pa.Table:
        gram, n, _ = _merged(table)
        last, counts, below = _top_sums(*weigh(gram, n, depth, False)[1:])
        return pa.table({"last": pa.array(last, pa.int32()), "counts": pa.array([x.tobytes() for x in counts], pa.binary()), "below": pa.array([x.tobytes() for x in below], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x) for x in table[c].to_pylist()).tobytes() for c in ("counts", "below")]
        return pa.table({"last": table["last"][:1].cast(pa.int32()), "counts": pa.array(total[:1], pa.binary()), "below": pa.array(total[1:], pa.binary())})

    schema = "last int, counts binary, below binary"
    parts = counted.agg(F.max("parts")).first()[0] or 1
    rows = counted.select("part", "grams", "n").repartition(parts, "part").groupBy("part").applyInArrow(sums, schema).groupBy("last").applyInArrow(add, schema)
    return Top([(r["last"], np.frombuffer(r["counts"]), np.frombuffer(r["below"])) for r in rows.collect()])  # 256 rows at most


def code_lengths(counted: DataFrame, wanted: DataFrame | None, depth: int, leave_out: bool) -> DataFrame:
    """(chunk, grams, bits), packed: code lengths of the wanted grams (chunk, part, grams), or of the counted ones, under the counted ones."""
    top = counted.sparkSession.sparkContext.broadcast(_top(counted, depth))
    rows = counted.select("chunk", "part", "grams", "n", F.lit(wanted is None).alias("wanted"))
    if wanted is not None:
        rows = rows.unionByName(wanted.select("chunk", "part", "grams", F.lit(None).cast("binary").alias("n"), F.lit(True).alias("wanted")))

    def run(table: pa.Table) -> pa.Table:
        gram, n, each = _merged(table)
        bits = top.value.code_lengths(gram, weigh(gram, n, depth, leave_out)[0], depth, leave_out).astype(np.float32)
        asked = table["wanted"].to_pylist()
        mine = [packed(bits[np.searchsorted(gram, g)]) for g, w in zip(each, asked) if w]
        asked = pa.array(asked)
        return pa.table({"chunk": table["chunk"].filter(asked), "grams": table["grams"].filter(asked), "bits": pa.array(mine, pa.binary())})

    parts = counted.agg(F.max("parts")).first()[0] or 1
    return rows.repartition(parts, "part").groupBy("part").applyInArrow(run, "chunk int, grams binary, bits binary")


def _scored(chunked: DataFrame, lengths: DataFrame, depth: int) -> DataFrame:
    kind = chunked.schema["doc_id"].dataType.simpleString()

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        gram = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpacked(x, np.int64)) for x in table["grams"].to_pylist())])
        bits = np.concatenate([np.zeros(0, np.float32), *(unpacked(x, np.float32) for x in table["bits"].to_pylist())])
        order = np.argsort(gram)
        gram, bits = gram[order], bits[order].astype(np.float64)
        out = []
        for b in K.chunks(iter(docs.to_batches()), COUNT_BYTES):
            buf, off = K.text_bytes(b.column(b.schema.get_field_index("text")))
            size, total = np.diff(off), np.zeros(b.num_rows)
            if len(buf):
                g = of_bytes(buf, off, depth)
                place = np.argsort(g)
                g = g[place]
                first = _firsts(g)
                each = np.empty(len(g))
                each[place] = np.repeat(bits[np.searchsorted(gram, g[first])], np.diff(np.append(first, len(g))))
                total = np.diff(np.concatenate([[0], np.cumsum(each)])[off])
            score = np.round(total / np.maximum(size, 1), 6)
            out.append(pa.record_batch([b.column(b.schema.get_field_index("doc_id")), pa.array(size), pa.array(score, mask=size == 0)], ["doc_id", "n_bytes", "bits_per_byte"]))
        return pa.Table.from_batches(out) if out else pa.table({"doc_id": docs["doc_id"], "n_bytes": pa.array([], pa.int64()), "bits_per_byte": pa.array([], pa.float64())})

    left = chunked.select("__el_chunk", "doc_id", "text").groupBy("__el_chunk")
    return left.cogroup(lengths.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, n_bytes long, bits_per_byte double")


def score(docs: DataFrame, model: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, n_bytes, bits_per_byte) of every document under the trees of train()'s corpus."""
    docs = docs.select("doc_id", "text")
    chunked = _chunked(docs, _size(docs))
    parts = model.agg(F.max("parts")).first()[0] or 1
    return _scored(chunked, code_lengths(model, gather(chunked, parts, depth), depth, False), depth)


def score_corpus(docs: DataFrame, depth: int = DEPTH, leave_out: bool = True) -> DataFrame:
    """(doc_id, n_bytes, bits_per_byte) of every document under the trees of all, each byte coded as if it alone were not in them (or, without leave_out, were)."""
    docs = docs.select("doc_id", "text")
    lengths = code_lengths(train(docs, depth), None, depth, leave_out)
    return _scored(_chunked(docs, _size(docs)), lengths, depth)
