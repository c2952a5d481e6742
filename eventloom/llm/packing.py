"""Best-fit packing into bins of several permitted sequence lengths.

Documents are measured in tokens and cut, where longer than the longest permitted length, into
full sequences and a rest.  Pieces, longest first, go to the open bin that they leave
least room in.  When none has room, the bin size is opened that costs least for each token it
can be expected to hold, given what is still to come; at the end each bin
shrinks to the least permitted length that holds its contents.

The whole corpus is packed as one.  Pieces of one length are alike and so are bins of one size and room, so
the driver packs a count for each length (SIZES[-1] rows at most, however many documents there are) and
moves runs of alike bins at once; the bins are those of packing piece by piece.  Each piece
then finds its bin by its rank among the pieces of its length.

Defined cases: a null or blank text has as many tokens as its bytes encode to, none if it has no bytes, and then is in no bin;
a very long text is cut; pieces of one length rank by doc_id (null last), then piece; equal room goes to the smaller bin;
repeated rows are packed as often as they occur; doc_id may be of any type that can be ordered; other columns, whatever their
names, have no influence; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe as B
from . import textkit as K

SIZES = (512, 1024, 2048, 4096, 8192)
RANKED_ROWS, PART_BINS = 1 << 20, 1 << 16


def cost(size: int, overhead: float = 16.0, quadratic: float = 0.1, longest: int = SIZES[-1]) -> float:
    """Of a sequence: its tokens, a fixed part, and a share that grows with the square as attention does."""
    return size * (1 + quadratic * size / longest) + overhead


def opened(n: int, ahead: int, sizes: Sequence[int], price: Sequence[float]) -> int:
    """Which size to open for a piece of n tokens, of `ahead` still to come with it: the least price for a token it can be expected to hold."""
    return min((i for i in range(len(sizes)) if sizes[i] >= n), key=lambda i: (price[i] / (n + min(sizes[i] - n, ahead - n)), -sizes[i]))


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES) -> list[tuple[int, int]]:
    """(bin, offset) of each length, piece by piece; lengths come longest first and fit the largest size."""
    sizes = sorted(sizes)
    price = [cost(s, longest=sizes[-1]) for s in sizes]
    ahead = int(sum(lengths))
    free: list[tuple[int, int, int]] = []  # (room, used, bin), sorted
    used: list[int] = []
    out = []
    for n in lengths:
        at = bisect_left(free, (n, -1, -1))
        if at < len(free):
            room, _, b = free.pop(at)
        else:
            room, b = sizes[opened(n, ahead, sizes, price)], len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        ahead -= n
        if room - n > 0:
            insort(free, (room - n, used[b], b))
    return out


@dataclass
class Plan:
    """runs: (length, first rank, ranks, bins that take one after the other `each` pieces, first bin, offset of the first piece);
    bins: (first bin, end, tokens in each), all in order."""

    runs: np.ndarray
    bins: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset in it, tokens in it) of the pieces of these lengths and ranks."""
        at = np.searchsorted(self.runs[:, 0] << 40 | self.runs[:, 1], length << 40 | rank, "right") - 1
        _, first, _, each, b, offset = self.runs[at].T
        bin_, nth = np.divmod(rank - first, each)
        bin_ += b
        return bin_, offset + nth * length, self.bins[np.searchsorted(self.bins[:, 0], bin_, "right") - 1, 2]


def plan(counts: dict[int, int], sizes: Sequence[int] = SIZES) -> Plan:
    """pack() over so many pieces of each length: alike bins are held as ranges of bin numbers and filled together."""
    sizes = sorted(sizes)
    price = [cost(s, longest=sizes[-1]) for s in sizes]
    ahead = sum(n * k for n, k in counts.items())
    open_: dict[tuple[int, int], list[tuple[int, int]]] = {}  # ranges of bins by (room, used)
    rooms: list[tuple[int, int]] = []  # the keys, sorted
    runs, full, bins = [], [], 0

    def put(key: tuple[int, int], span: tuple[int, int]) -> None:
        if key[0] == 0:
            full.append((*span, key[1]))
        elif key in open_:
            open_[key].append(span)
        else:
            open_[key] = [span]
            insort(rooms, key)

    for n in sorted(counts, reverse=True):
        rank, left = 0, counts[n]
        while left:
            at = bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, used = key = rooms[at]
                start, end = open_[key].pop()
                if not open_[key]:
                    del open_[key], rooms[at]
            else:
                size = sizes[opened(n, ahead, sizes, price)]
                room, used = size, 0
                # while a largest bin's worth and more is to come, the choice is the same for all
                many = max(1, min(-(-left // (size // n)), (ahead - sizes[-1]) // (n * (size // n))))
                start, end = bins, bins + many
                bins = end
            each = room // n
            whole = min(end - start, left // each)
            if whole:
                runs.append((n, rank, whole * each, each, start, used))
                put((room - each * n, used + each * n), (start, start + whole))
                rank, left, ahead = rank + whole * each, left - whole * each, ahead - whole * each * n
            if start + whole < end and left:  # the last bin takes the few that are left
                runs.append((n, rank, left, each, start + whole, used))
                put((room - left * n, used + left * n), (start + whole, start + whole + 1))
                ahead -= left * n
                rank, left, whole = rank + left, 0, whole + 1
            if start + whole < end:
                put((room, used), (start + whole, end))
    full += [(*span, used) for (_, used), spans in open_.items() for span in spans]
    return Plan(np.array(sorted(runs), np.int64).reshape(-1, 6), np.array(sorted(full), np.int64).reshape(-1, 3))


def shrink(used: np.ndarray, sizes: Sequence[int] = SIZES) -> np.ndarray:
    """The least permitted length that holds each bin's contents."""
    s = np.array(sorted(sizes))
    return s[np.searchsorted(s, used)]


def token_counts(docs: DataFrame, tokenizer: str = B.TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    docs = docs.select("doc_id", "text")
    vocabulary = docs.sparkSession.sparkContext.broadcast(B.Bpe.load(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = B.encoder(vocabulary.value, tokenizer)
        for b in K.chunks(batches):
            yield pa.record_batch([b.column(0), pa.array(enc.counts(b.column(1)))], ["doc_id", "n_tokens"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def best_fit(lengths: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    """Pack (doc_id, n_tokens): one row a piece of a document in its bin; `part` deals the bins out by PART_BINS, to write them apart."""
    largest = max(sizes)
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / largest).cast("int") - 1)).alias("piece")
    pieces = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", piece)
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest), F.col("n_tokens") - F.col("piece").cast("long") * largest).alias("n_tokens"))
    # pieces of one length rank in groups of about RANKED_ROWS, so that a common length is no single task's
    share = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(1 << 20))
    often = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    common = [(n, -(-k // RANKED_ROWS)) for n, k in often.items() if k > RANKED_ROWS]
    ways = F.coalesce(F.create_map(*[F.lit(x) for pair in common for x in pair])[F.col("n_tokens")], F.lit(1)) if common else F.lit(1)
    grouped = pieces.withColumn("grp", F.pmod(share, ways).cast("int"))
    before, seen = {}, dict.fromkeys(often, 0)
    if common:
        some = [n for n, _ in common]
        for r in sorted(grouped.where(F.col("n_tokens").isin(some)).groupBy("n_tokens", "grp").count().collect()):
            before[r["n_tokens"], r["grp"]] = seen[r["n_tokens"]]
            seen[r["n_tokens"]] += r["count"]
    packed = plan(often, sizes)
    order = [F.col("doc_id").asc_nulls_last(), "piece"]
    ranked = grouped.withColumn("rank", (F.row_number().over(Window.partitionBy("n_tokens", "grp").orderBy(*order)) - 1).cast("long"))
    sent = lengths.sparkSession.sparkContext.broadcast((packed, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, before = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            size, grp, rank = (b.column(i).to_numpy() for i in (2, 3, 4))
            if before:
                rank = rank + np.array([before.get(x, 0) for x in zip(size.tolist(), grp.tolist())], np.int64)
            bin_, at, filled = packed.place(size, rank)
            narrow = [pa.array(x, pa.int32()) for x in (shrink(filled, sizes), filled, at, size)]
            yield pa.record_batch(
                [pa.array(bin_ // PART_BINS, pa.int32()), pa.array(bin_), *narrow[:2], b.column(0), b.column(1), *narrow[2:]],
                ["part", "bin", "capacity", "filled", "doc_id", "piece", "at", "n_tokens"],
            )

    kind = lengths.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "n_tokens", "grp", "rank").mapInArrow(run, f"part int, bin long, capacity int, filled int, doc_id {kind}, piece int, at int, n_tokens int")


def pack_documents(docs: DataFrame, sizes: Sequence[int] = SIZES) -> DataFrame:
    return best_fit(K.materialize(token_counts(docs), "lengths"), sizes)
