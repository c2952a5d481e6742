"""N-gram Jaccard self join by MinHash banding.

A document is the set of its word n-grams (64-bit hashes).  Rows a band and number of
bands follow from the threshold and the recall asked for at it.  Documents with equal
sets are first folded into one, exactly.  What is left meets on band hashes.  Of each
document the least one that it shares a band with is its label; documents of one label, in blocks of BLOCK, are a tile.
Two tiles are compared where documents of both share a band, and of those tiles only such documents: their texts
are sent once for each pair of tiles, and all pairs are verified on the full n-gram sets.  So a task holds two
blocks at most, no candidate is dropped, and documents that are only connected through others never meet.

near_links gives a row for each document: its class, which is what it is connected with, and the number of its links, counted
where the pairs are verified, so that what leaves a task grows with the documents and not with the pairs; a folded document counts
for all that it stands for.  near_pairs names every pair, those of equal sets too.

Defined cases: a null or blank text has an empty set and pairs with nothing, as
does a row without doc_id, which near_links leaves out; doc_id may be of any type that can be ordered.  Rows of one doc_id are one document, which is
linked by any of them: they never pair with each other, and a pair comes out, and counts, once whatever rows it has, with the highest
Jaccard of them; keep_one keeps or drops such rows together.
A text of fewer than n words is one n-gram of all its words, a very long one is taken whole.  Equal
sets tie at Jaccard 1; of a group the least doc_id stays and names the class.  Other columns, whatever their names, have no influence and
are kept by keep_one.  An empty table gives empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fuse
from . import textkit as K

BLOCK = 512


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which `most` hashes give the recall at the threshold."""
    best = None
    for rows in range(1, 17):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if best is None or bands * rows <= most:
            best = (bands, rows)
    return best


def signatures(n: int, bands: int, rows: int, kind: str, seed: int = 7):
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            words, first = K.word_hashes(b.column(1))
            sh, off = K.shingle_hashes(words, first, n)
            some = np.flatnonzero(np.diff(off) > 0)
            if not len(some):
                continue
            start = off[some]
            low = (sh >> np.uint64(32)).astype(np.uint32)
            out = np.empty((len(some), bands), np.uint64)
            for band in range(bands):
                acc = np.full(len(some), band + 1, np.uint64)
                for r in range(band * rows, (band + 1) * rows):
                    acc = K.mix(acc ^ np.minimum.reduceat(low * mult[r] + add[r], start).astype(np.uint64))
                out[:, band] = acc
            sets = [np.unique(sh[off[i] : off[i + 1]]) for i in some]
            d1 = np.array([s.sum(dtype=np.uint64) for s in sets])
            d2 = np.array([K.mix(s).sum(dtype=np.uint64) for s in sets])
            yield pa.record_batch(
                [
                    b.column(0).take(pa.array(some)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    K.list_array(out.view(np.int64).ravel(), np.arange(len(some) + 1) * bands, pa.int64()),
                ],
                ["doc_id", "size", "d1", "d2", "bands"],
            )

    return run, f"doc_id {kind}, size int, d1 long, d2 long, bands array<long>"


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the first `keys` columns, from sorted batches."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = np.stack([t.column(i).to_numpy() for i in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1)]
        for at, end in zip(cut, cut[1:]):
            yield t.slice(at, end - at)
        rest = t.slice(cut[-1]) if t.num_rows else None
    if rest is not None and rest.num_rows:
        yield rest


def jaccard_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard of all pairs of sorted unique arrays, by products of incidence blocks."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    who = np.repeat(np.arange(m), size.astype(int))
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = df[code] > 1
    code, who = code[keep], who[keep]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, who = code[order], who[order]
    width = int(code[-1]) + 1 if len(code) else 0
    both = np.zeros((m, m))
    step = max(256, (1 << 22) // m)
    for at in range(0, width, step):
        lo, hi = np.searchsorted(code, [at, at + step])
        x = np.zeros((m, min(step, width - at)), np.float32)
        x[who[lo:hi], code[lo:hi] - at] = 1
        both += x @ x.T
    return both / np.maximum(size[:, None] + size[None, :] - both, 1)


def compared(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (lo, hi, tile, doc_id, copies, text) sorted by lo, hi and doc_id, for each pair of tiles: the rows, the number of each row's
    document, and the pairs of rows at the threshold, of a lesser and a greater document, with their Jaccard."""
    for t in groups(batches, 2):
        if t.num_rows < 2:
            continue
        t = t.combine_chunks()
        words, first = K.word_hashes(t.column("text").chunk(0))
        sh, off = K.shingle_hashes(words, first, n)
        sets = [np.unique(sh[a:b]) for a, b in zip(off, off[1:])]
        ids, tile = t.column("doc_id").chunk(0), t.column("tile").to_numpy()
        if len(sets) == 2:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            j = both / max(1, len(sets[0]) + len(sets[1]) - both)
            jac = np.array([[1, j], [j, 1]])
        else:
            jac = jaccard_matrix(sets)
        order = np.concatenate([[0], np.cumsum(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))])
        a, b = np.nonzero(jac >= threshold)
        ok = (order[a] < order[b]) & ((tile[a] != tile[b]) if t.column("lo")[0] != t.column("hi")[0] else True)
        a, b = a[ok], b[ok]
        if len(a):
            yield t, order, a, b, jac[a, b]


def verifier(n: int, threshold: float, kind: str):
    """The pairs at the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _, a, b, jac in compared(batches, n, threshold):
            ids = t.column("doc_id").chunk(0)
            yield pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(np.round(jac, 6))], ["a", "b", "jaccard"])

    return run, f"a {kind}, b {kind}, jaccard double"


def first_linked(adj: np.ndarray) -> np.ndarray:
    """The first node of each node's connected component."""
    first = np.full(len(adj), -1)
    for i in range(len(adj)):
        new = np.arange(len(adj)) == i if first[i] < 0 else np.zeros(0, bool)
        while new.any():
            first[new] = i
            new = adj[new].any(0) & (first < 0)
    return first


def counter(n: int, threshold: float, kind: str):
    """For each pair of tiles and document linked in it: the links, copies included, and the least document it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, order, a, b, _ in compared(batches, n, threshold):
            at = np.searchsorted(order, np.arange(order[-1] + 1))
            ids, copies = t.column("doc_id").chunk(0), t.column("copies").to_numpy()[at]
            adj = np.zeros((len(at), len(at)), bool)
            adj[order[a], order[b]] = adj[order[b], order[a]] = True
            some = np.flatnonzero(adj.any(0))
            links = np.array([copies[adj[i]].sum() for i in some], np.int64)
            yield pa.record_batch([ids.take(pa.array(at[some])), pa.array(links), ids.take(pa.array(at[first_linked(adj)[some]]))], ["doc_id", "links", "first"])

    return run, f"doc_id {kind}, links long, first {kind}"


def candidates(docs: DataFrame, n: int = 3, threshold: float = 0.6, recall: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep, copies) of the documents of which others have the same sets, and what compared() takes, of all others and representatives."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    bands, rows = banding(threshold, recall)
    sig = K.materialize(docs.mapInArrow(*signatures(n, bands, rows, kind)), "minhash")
    key = ["size", "d1", "d2"]
    sets = sig.select("doc_id", *key).repartition("doc_id").distinct().groupBy("doc_id")
    sets = sets.agg(F.sum("size").alias("size"), F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"))
    same = sets.groupBy(key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    member = K.materialize(sets.join(same, key).select("doc_id", "rep", "copies"), "equal-sets")

    reps = sig.join(member.where("rep <> doc_id"), "doc_id", "left_anti")
    band = Window.partitionBy("band")
    found = reps.select("doc_id", "size", F.explode("bands").alias("band")).select("*", F.min("doc_id").over(band).alias("least"), F.max("doc_id").over(band).alias("most"))
    buckets = K.materialize(found.where("least <> most").select("band", "doc_id", "size", "least"), "buckets")
    label = buckets.groupBy("doc_id").agg(F.min("least").alias("label"))
    blocks = label.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    tile = label.join(blocks, "label").select("doc_id", F.xxhash64("label", F.pmod(F.xxhash64("doc_id"), "blocks")).alias("tile"))
    met = buckets.join(tile, "doc_id").withColumn("others", F.collect_set("tile").over(band)).select("doc_id", "size", "tile", F.explode("others").alias("other"))
    met = met.select("doc_id", "size", "tile", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"))
    wanted = K.materialize(met.groupBy("lo", "hi", "tile", "doc_id").agg(F.max("size").alias("size")), "tiles")

    n_bytes = 8 * (wanted.agg(F.sum("size")).first()[0] or 0)
    mine = fuse.flag(docs, F.xxhash64("doc_id"), wanted.select(F.xxhash64("doc_id").alias("h")).distinct()).where("__el_maybe")
    wanted = wanted.join(member.where("rep = doc_id").select("doc_id", "copies"), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    rows_ = mine.join(wanted, "doc_id").select("lo", "hi", "tile", "doc_id", "copies", "text")
    return member, K.spread(rows_, n_bytes, "lo", "hi").sortWithinPartitions("lo", "hi", "doc_id")


def near_links(docs: DataFrame, n: int = 3, threshold: float = 0.6, recall: float = 0.95) -> DataFrame:
    """(doc_id, class_id, links) of each doc_id: the least doc_id of those it is connected with, and the number of other documents at the threshold."""
    member, tiles = candidates(docs, n, threshold, recall)
    found = K.materialize(tiles.mapInArrow(*counter(n, threshold, docs.schema["doc_id"].dataType.simpleString())), "tile-links")
    classes = K.components(found.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))).toDF("rep", "root")
    links = found.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("others"))
    every = docs.select("doc_id").where("doc_id is not null").distinct().join(member, "doc_id", "left")
    every = every.withColumn("rep", F.coalesce("rep", "doc_id")).join(links, "rep", "left").join(classes, "rep", "left")
    return every.select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.expr("coalesce(copies - 1, 0) + coalesce(others, 0)").alias("links"))


def near_pairs(docs: DataFrame, n: int = 3, threshold: float = 0.6, recall: float = 0.95) -> DataFrame:
    """(doc_a, doc_b, jaccard), doc_a < doc_b: every pair found at the threshold, and every pair of equal sets; they grow with the square of a group."""
    member, tiles = candidates(docs, n, threshold, recall)
    pairs = tiles.mapInArrow(*verifier(n, threshold, docs.schema["doc_id"].dataType.simpleString())).groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))
    lists = member.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / BLOCK))).groupBy("rep", "part").agg(F.collect_list("doc_id").alias("ids"))
    every = pairs.unionByName(member.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("jaccard")).distinct())
    for side in "ab":
        mine = lists.select(F.col("rep").alias(side), F.col("part").alias(f"part_{side}"), F.col("ids").alias(f"ids_{side}"))
        every = every.join(mine, side, "left").withColumn(f"ids_{side}", F.coalesce(f"ids_{side}", F.array(side)))
    every = K.materialize(every.where("a <> b or part_a <= part_b"), "pair-blocks")
    rows = every.agg(F.sum(F.size("ids_a") * F.size("ids_b").cast("long"))).first()[0] or 0
    every = K.spread(every, 24 * rows, "a", "b", "part_a", "part_b")
    each = every.select(F.explode("ids_a").alias("x"), "ids_b", "jaccard", F.expr("a = b and part_a = part_b").alias("own"))
    each = each.select("x", F.explode("ids_b").alias("y"), "jaccard", "own").where("x < y or (not own and x > y)")
    return each.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").distinct()


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one document, that of the least doc_id, of each class of near_links()."""
    gone = near_links(docs, **how).where("doc_id <> class_id").select("doc_id")
    return fuse.without(docs, K.materialize(gone, "near-gone"))
