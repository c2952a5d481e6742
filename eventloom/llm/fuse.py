"""Binary-fuse filters, and their use to leave wide rows out of a shuffle.

A static filter over a set of 64-bit keys answers "surely not" or "maybe" (wrong for one key in
256) with 8-bit fingerprints, about nine bits a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K

BUCKET_KEYS = 200_000
SENT_BYTES = 64 << 20


def _slots(keys: np.ndarray, seed: int, seg: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    h = K.mix(keys + np.uint64(seed))
    base = ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
    start = base * np.uint64(seg)
    m = np.uint64(seg - 1)
    g = K.mix(h ^ np.uint64(0xA5A5A5A5DEADBEEF))
    s = np.stack([start + (g & m), start + np.uint64(seg) + ((g >> np.uint64(21)) & m), start + np.uint64(2 * seg) + ((g >> np.uint64(42)) & m)])
    return s.astype(np.int64), (h & np.uint64(0xFF)).astype(np.uint8)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, fingerprints) of a three-wise binary-fuse filter of distinct uint64 keys."""
    keys = np.unique(keys)
    n = len(keys)
    seg = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    seg = min(seg, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))
    count = max(1, -(-int(np.ceil(n * factor)) // seg) - 2 + 1)
    for seed in range(1, 1000):
        size = (count + 2) * seg
        s, fp = _slots(keys, seed, seg, count)
        alive = np.ones(n, bool)
        order: list[tuple[np.ndarray, np.ndarray]] = []
        degree = np.bincount(s.ravel(), minlength=size)
        ids = np.zeros(size, np.int64)
        for r in range(3):
            np.bitwise_xor.at(ids, s[r], np.arange(n))
        left = n
        ready = np.flatnonzero(degree == 1)
        while len(ready):
            k, where = np.unique(ids[ready], return_index=True)
            own = ready[where]
            live = alive[k]
            k, own = k[live], own[live]
            alive[k] = False
            left -= len(k)
            order.append((k, own))
            touched = s[:, k].ravel()
            np.subtract.at(degree, touched, 1)
            np.bitwise_xor.at(ids, touched, np.tile(k, 3))
            touched = np.unique(touched)
            ready = touched[degree[touched] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            for k, own in reversed(order):
                table[own] = 0
                table[own] = fp[k] ^ table[s[0, k]] ^ table[s[1, k]] ^ table[s[2, k]]
            return seed, seg, count, table.tobytes()
        if seed % 8 == 0:
            count += max(1, count // 16)
    raise RuntimeError("no seed peels this key set")


def fuse_probe(keys: np.ndarray, seed: int, seg: int, count: int, table: bytes) -> np.ndarray:
    t = np.frombuffer(table, np.uint8)
    s, fp = _slots(keys, seed, seg, count)
    return (t[s[0]] ^ t[s[1]] ^ t[s[2]]) == fp


def build_filters(keys: DataFrame) -> DataFrame:
    """One filter for each bucket of (bucket, h): (bucket, seed, seg, cnt, prints)."""

    def build(table: pa.Table) -> pa.Table:
        seed, seg, count, prints = fuse_build(table["h"].to_numpy().view(np.uint64))
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "seed": pa.array([seed], pa.int32()), "seg": pa.array([seg], pa.int32()), "cnt": pa.array([count], pa.int32()), "prints": pa.array([prints], pa.binary())})

    return keys.select("bucket", "h").distinct().groupBy("bucket").applyInArrow(build, "bucket int, seed int, seg int, cnt int, prints binary")


def flag(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """docs with __el_maybe: false only where key, a long, is surely not in the one column h of keys, or is null.

    The filters of all keys are sent to the tasks while they take SENT_BYTES at most; beyond that every row with a key is a maybe.
    """
    n = keys.count()
    if n * 10 // 8 > SENT_BYTES:
        return docs.withColumn("__el_maybe", key.isNotNull())
    buckets = -(-n // BUCKET_KEYS) or 1
    filters = build_filters(keys.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int")))
    sent = docs.sparkSession.sparkContext.broadcast({r["bucket"]: (r["seed"], r["seg"], r["cnt"], bytes(r["prints"])) for r in filters.collect()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_columns - 2
            h, bucket = b.column(m), b.column(m + 1).to_numpy(zero_copy_only=False)
            k = h.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.zeros(len(k), bool)
            for i in np.unique(bucket):
                if (f := sent.value.get(int(i))) is not None:
                    at = np.flatnonzero(bucket == i)
                    hit[at] = fuse_probe(k[at], *f)
            hit &= h.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:m], pa.array(hit)], names=[*b.schema.names[:m], "__el_maybe"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__el_maybe", T.BooleanType())])
    keyed = docs.withColumn("__el_h", key.cast("long"))
    return keyed.withColumn("__el_b", F.pmod(F.xxhash64("__el_h"), F.lit(buckets)).cast("int")).mapInArrow(run, schema)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs whose doc_id is not in the one column of ids, of the same type; only rows that may be are shuffled."""
    named = ids.toDF("__el_id")
    flagged = flag(docs, F.expr("if(doc_id is null, null, xxhash64(doc_id))"), named.select(F.xxhash64("__el_id").alias("h")))
    maybe = flagged.where("__el_maybe")
    rest = maybe.join(named, maybe["doc_id"] == named["__el_id"], "left_anti")
    return flagged.where("not __el_maybe").select(*docs.columns).unionByName(rest.select(*docs.columns))
