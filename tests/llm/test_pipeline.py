"""The pipeline over the smallest documents, each stage against a plain statement of what it does."""

from itertools import combinations
from pathlib import Path

import pytest

import corpus_pipeline
from eventloom.llm import bpe, queries, secrets, textkit

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def test_stages(spark):
    docs = queries.documents(spark, str(SF))
    names, tables = [n for n, _ in corpus_pipeline.STAGES], [docs]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "secret_scans", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(textkit.materialize(stage(spark, tables[-1], str(SF)), name))
    start, good, exact, near, clean, bins = (t.collect() for t in tables)
    assert all(t.columns == docs.columns for t in tables[1:5])
    assert {r["doc_id"] for r in good} < {r["doc_id"] for r in start}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r["doc_id"] in {x["doc_id"] for x in good} for r in start if labels.get(r["doc_id"]) == 1)
    # exact: one of each text, even ids first
    want = {}
    for r in sorted(good, key=lambda r: (r["doc_id"] % 2, r["doc_id"])):
        want.setdefault(r["text"], r["doc_id"])
    assert {r["doc_id"] for r in exact} == set(want.values())
    # near: the pairs left are under the threshold, and whatever went has a near one that is less
    sets = {r["doc_id"]: shingles(r["text"]) for r in exact}
    near_pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])]
    left = {r["doc_id"] for r in near}
    assert all(any(b == gone for _, b in near_pairs) for gone in set(sets) - left)
    assert sum(a in left and b in left for a, b in near_pairs) <= 0.1 * len(near_pairs)
    z = secrets.compressor("")
    assert len(clean) == len(near)
    assert not any(secrets.found(z, r["text"]) for r in clean)
    v = bpe.Bpe.load()
    assert sum(r["n_tokens"] for r in bins) == sum(len(v.encode(r["text"])) for r in clean)


def test_empty_and_odd(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = textkit.materialize(stage(spark, docs, ""), "stage")
        corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def test_registered():
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        textkit.shared_dir(Cluster)


def test_tables_are_removed(spark):
    kept = []
    with textkit.released(spark, kept):
        gone = textkit.materialize(spark.range(3), "gone")
        path = Path(gone.inputFiles()[0].removeprefix("file://"))
        assert path.exists()
        kept.append(textkit.materialize(gone, "kept"))
    assert kept[0].count() == 3
    assert not path.exists()
