"""Exact duplicates with static binary-fuse filters.

Documents come as an immutable snapshot and a new batch.  build_snapshot() writes once what later batches are
screened by: the snapshot's digests, cut into buckets, and for each bucket one binary-fuse filter (8-bit fingerprints,
about nine bits a key).  screen() reads nothing else of the snapshot: a new digest goes to its bucket's filter, and only
positives meet the bucket's exact digests.  Documents whose digests are confirmed have their bytes compared; duplicates inside
the new batch are grouped apart.  Snapshot filters are never broadcast: filters and digests
meet by a shuffle on the bucket, of which there are as many as the snapshot needs.
To fetch the texts to compare, one more filter, of the repeated digests alone, leaves
the other texts where they are; it is sent to all tasks while it takes at most
fuse.SENT_BYTES, else all texts are shuffled.

Defined cases: a null text is no duplicate of anything and always stays; equal empty
texts are duplicates, as are very long ones, which are compared whole.  The keeper of a group is the snapshot's least doc_id, or if
the snapshot has none the batch's least; a null doc_id comes last, and then
the remaining columns (as JSON) decide ties, so that of repeated rows one stays.  Other columns may have any names and are kept
by keep_one; doc_id may be of any type that can be ordered.  An empty snapshot or batch gives no pairs between the two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from . import textkit as K



def _digests(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("digest")).count()


def _bucket(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))


def build_snapshot(docs: DataFrame, path: str | None = None) -> str:
    """Write the digests and filters of an immutable snapshot to path (by default one in the shared folder, for this session); returns it."""
    spark = docs.sparkSession
    path = path or K.temporary_path(spark, "snapshot")
    buckets = -(-max(1, docs.count()) // fuse.BUCKET_KEYS) * 8
    _bucket(_digests(docs), buckets).write.parquet(f"{path}/digests")
    fuse.build_filters(spark.read.parquet(f"{path}/digests")).write.parquet(f"{path}/filters")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/complete")
    return path


def screen(path: str, batch: DataFrame) -> DataFrame:
    """The digests (h, digest) of the batch that the snapshot at path holds; its documents are not read."""
    return screen_digests(path, _digests(batch))


def screen_digests(path: str, digests: DataFrame) -> DataFrame:
    spark = digests.sparkSession
    buckets = spark.read.parquet(f"{path}/complete").first()["buckets"]
    known = spark.read.parquet(f"{path}/digests")
    new = _bucket(digests.select("h", "digest"), buckets)
    positive = pass_filters(spark.read.parquet(f"{path}/filters"), new)
    return positive.join(known.select("bucket", "digest"), ["bucket", "digest"], "left_semi").select("h", "digest")


def pass_filters(filters: DataFrame, digests: DataFrame) -> DataFrame:
    """The digests that their bucket's filter lets through; a bucket without a filter lets none through."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return right.slice(0, 0)
        f = left.to_pylist()[0]
        hit = fuse.fuse_probe(right["h"].to_numpy().view(np.uint64), f["seed"], f["seg"], f["cnt"], f["prints"])
        return right.filter(pa.array(hit))

    return filters.groupBy("bucket").cogroup(digests.groupBy("bucket")).applyInArrow(probe, digests.schema)


def repeated_digests(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """Digests (h, md5) that occur more than once: in both parts (through the filters), or within one."""
    path = build_snapshot(snapshot)
    old, new = snapshot.sparkSession.read.parquet(f"{path}/digests"), K.materialize(_digests(batch), "batch")
    inside = [d.where("count > 1").select("h", "digest") for d in (old, new)]
    return K.materialize(screen_digests(path, new).union(inside[0]).union(inside[1]).distinct(), "repeated")


def _order(docs: DataFrame, part: Column) -> Column:
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return F.struct(
        F.coalesce(part.cast("int"), F.lit(1)).alias("p"),
        F.col("doc_id").isNull().alias("n"),
        F.col("doc_id").alias("i"),
        (F.to_json(F.struct(*rest)) if rest else F.lit("")).alias("j"),
    )


def _parts(docs: DataFrame, in_batch: Column) -> tuple[DataFrame, DataFrame]:
    late = F.coalesce(in_batch, F.lit(True))
    return docs.where(~late), docs.where(late)


def duplicates(docs: DataFrame, in_batch: Column) -> DataFrame:
    """(doc_id, keeper_id) for each document whose bytes an earlier one has; in_batch tells the new batch from the snapshot.

    Rows of one doc_id and text count as one document here.
    """
    docs = docs.select("doc_id", "text", in_batch.alias("__el_part"))
    snapshot, batch = _parts(docs, F.col("__el_part"))
    again = repeated_digests(snapshot, batch)
    rows = fuse.flag(docs.where("doc_id is not null and text is not null"), F.xxhash64("text"), again.select("h")).where("__el_maybe")
    rows = rows.withColumn("digest", F.md5("text")).join(again.select("digest"), "digest", "left_semi")
    rows = K.materialize(rows, "candidates")
    keeper = rows.groupBy("digest", "text").agg(F.min(F.struct(F.coalesce(F.col("__el_part").cast("int"), F.lit(1)).alias("p"), F.col("doc_id").alias("i"))).alias("k"))
    keeper = keeper.select("digest", F.col("text").alias("ktext"), F.col("k.i").alias("keeper_id"))
    pairs = rows.join(keeper, (rows["digest"] == keeper["digest"]) & (F.col("text") == F.col("ktext")))
    return pairs.where("doc_id <> keeper_id").select("doc_id", "keeper_id").distinct()


def keep_one(docs: DataFrame, in_batch: Column) -> DataFrame:
    """docs without the rows whose text an earlier row has; the columns stay as they are."""
    snapshot, batch = _parts(docs.select("text", in_batch.alias("__el_part")), F.col("__el_part"))
    again = repeated_digests(snapshot, batch)
    flagged = fuse.flag(docs, F.expr("if(text is null, null, xxhash64(text))"), again.select("h"))
    maybe = flagged.where("__el_maybe").withColumn("__el_digest", F.md5("text"))
    same = again.select(F.col("digest").alias("__el_digest"))
    single = flagged.where("not __el_maybe").select(*docs.columns)
    single = single.unionByName(maybe.join(same, "__el_digest", "left_anti").select(*docs.columns))
    several = maybe.join(same, "__el_digest", "left_semi").withColumn("__el_order", _order(docs, in_batch))
    rest = [c for c in docs.columns if c != "text"]
    one = several.groupBy("__el_digest", "text").agg(F.min_by(F.struct(*rest), F.col("__el_order")).alias("__el_row"))
    return single.unionByName(one.select("text", "__el_row.*").select(*docs.columns))
