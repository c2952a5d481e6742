"""Exact duplicates, n-gram join and passages against brute force."""

import hashlib
import random
import shutil
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import exact, fuse, ngram_join, substring, textkit
from eventloom.llm.queries import in_batch


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    f = fuse.fuse_build(keys)
    assert fuse.fuse_probe(keys, *f).all()
    others = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert fuse.fuse_probe(others, *f).mean() < 0.02


def test_exact_pairs(spark, odd_docs):
    got = {(r["doc_id"], r["keeper_id"]) for r in exact.duplicates(odd_docs, in_batch()).collect()}
    assert got == {(9, 2), (5, 6), (7, 8)}


def test_snapshot_outlives_its_documents(spark, tmp_path, odd_docs):
    at = str(tmp_path / "docs")
    odd_docs.write.parquet(at)
    path = exact.build_snapshot(spark.read.parquet(at), str(tmp_path / "snapshot"))
    shutil.rmtree(at)
    for texts, want in ((["ties", "new", None, "new"], {"ties"}), (["other", ""], {""}), ([], set())):
        batch = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        assert {r["digest"] for r in exact.screen(path, batch).collect()} == {hashlib.md5(t.encode()).hexdigest() for t in want}
    nothing = exact.build_snapshot(odd_docs.limit(0), str(tmp_path / "nothing"))
    assert exact.screen(nothing, odd_docs).count() == 0


def test_exact_with_other_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "x"), ("2", "y"), (None, "y"), ("3", "y")], "doc_id string, text string")
    assert {tuple(r) for r in exact.duplicates(docs, in_batch()).collect()} == {("b", "a"), ("3", "2")}
    assert sorted(r["doc_id"] for r in exact.keep_one(docs, in_batch()).collect()) == ["2", "a"]


def test_exact_keep_one(spark, odd_docs):
    kept = exact.keep_one(odd_docs, in_batch())
    assert kept.columns == odd_docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "-")[:10]) for r in kept.collect())
    assert [g[0] for g in got] == [0, 0, 1, 2, 3, 6, 8, 10]


def test_empty_tables(spark, no_docs):
    assert exact.duplicates(no_docs, in_batch()).count() == 0
    assert exact.keep_one(no_docs, in_batch()).count() == 0
    assert ngram_join.near_pairs(no_docs).count() == 0
    assert ngram_join.keep_one(no_docs).count() == 0
    assert substring.near_passages(no_docs).count() == 0


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def edited(rng, text, rate):
    return " ".join(f"new{rng.randint(0, 10**6)}" if rng.random() < rate else w for w in text.split())


def test_near_pairs(spark, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)  # several blocks to a cluster
    rng = random.Random(3)
    texts = [prose(rng.randint(1, 150)) for _ in range(40)]
    for i in range(0, 40, 2):
        texts += [edited(rng, texts[i], r) for r in (0.0, 0.02, 0.05, 0.1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_a"], r["doc_b"]): r["jaccard"] for r in ngram_join.near_pairs(docs).collect()}
    sets = [shingles(t, 3) for t in texts]
    want = {(a, b): j for a, b in combinations(range(len(texts)), 2) if (j := len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))) >= 0.6}
    assert all(want[k] == pytest.approx(v, abs=1e-6) for k, v in got.items())
    assert sum(k in got for k in want) >= 0.9 * len(want)
    assert all(k in got for k, j in want.items() if j == 1)
    kept = {r["doc_id"] for r in ngram_join.keep_one(docs).collect()}
    assert all(i in kept for i in range(1, 40, 2))
    assert len(kept) < 70


def test_pairs_of_copies(spark, prose, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    text = prose(200)
    near = " ".join(["other", *text.split()[1:]])
    docs = spark.createDataFrame([(f"d{i}", text if i < 8 else near if i < 12 else prose(50)) for i in range(14)] + [("d0", text)], "doc_id string, text string")
    got = {(r["doc_a"], r["doc_b"]) for r in ngram_join.near_pairs(docs).collect()}
    assert got == set(combinations(sorted(f"d{i}" for i in range(12)), 2))
    assert sorted({r["doc_id"] for r in ngram_join.keep_one(docs).collect()}) == ["d0", "d12", "d13"]


def links_of(docs):
    return {r["doc_id"]: (r["class_id"], r["links"]) for r in ngram_join.near_links(docs).collect()}


@pytest.mark.parametrize("block", [4, 512])
def test_links_and_classes(spark, prose, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for _ in range(4):  # copies of near copies, all of one another
        text = prose(150)
        texts += [t for i in range(6) for t in [f"{prose(1)} {text} {i}"] * rng.randint(1, 4)]
    texts += [prose(80) for _ in range(10)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 3) for t in texts]
    near = [{j for j, s in enumerate(sets) if len(s & mine) >= 0.6 * len(s | mine)} for mine in sets]
    assert links_of(docs) == {i: (min(n), len(n) - 1) for i, n in enumerate(near)}
    chain = [" ".join(f"w{i}" for i in range(at, at + 100)) for at in (0, 10, 20, 30, 40)]  # linked to the next one and the one after it
    docs = spark.createDataFrame([(9 - i, t) for i, t in enumerate(chain)], "doc_id long, text string")
    want = [sum(a != b and (d := abs(a - b)) * 10 <= 98 and (98 - 10 * d) / (98 + 10 * d) >= 0.6 for b in range(5)) for a in range(5)]
    assert links_of(docs) == {9 - i: (5, n) for i, n in enumerate(want)}


def test_links_of_repeated_ids(spark, prose, odd_docs):
    a, b, c = prose(90), prose(90), prose(90)
    near_b = f"{b} more"
    rows = [("1", a), ("1", b), ("1", near_b), ("2", a), ("3", b), ("3", b), ("4", c), ("5", near_b), ("6", near_b)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert links_of(docs) == {"1": ("1", 4), "2": ("1", 1), "3": ("1", 3), "4": ("4", 0), "5": ("1", 3), "6": ("1", 3)}
    got = {(r["doc_a"], r["doc_b"]) for r in ngram_join.near_pairs(docs).collect()}
    assert got == {("1", "2"), ("1", "3"), ("1", "5"), ("1", "6"), ("3", "5"), ("3", "6"), ("5", "6")}
    assert {r["doc_id"] for r in ngram_join.keep_one(docs).collect()} == {"1", "4"}
    assert links_of(odd_docs) == {i: (i, 0) for i in (1, 2, 3, 9, 10)} | {5: (5, 1), 6: (5, 1), 7: (7, 1), 8: (7, 1)}
    assert links_of(odd_docs.limit(0)) == {}


def test_join_gives_a_row_for_each_document(spark, prose, tmp_path):
    from __spark_entry__ import queries

    text = prose(100)
    docs = [(i, f"{text} {i}" if i < 30 else text) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op7_ngram_jaccard_join"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "class_id", "links"]
    assert {tuple(r) for r in got.collect()} == {(i, 0, 59) for i in range(60)} and got.count() == 60


def test_near_odd(spark, odd_docs):
    assert {(r["doc_a"], r["doc_b"]) for r in ngram_join.near_pairs(odd_docs).collect()} == {(5, 6), (7, 8)}
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 7, 7, 9, 10]


def test_banding():
    for t in (0.4, 0.6, 0.8, 0.95):
        bands, rows = ngram_join.banding(t, 0.95)
        assert 1 - (1 - t**rows) ** bands >= 0.95


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), *[(100 + i, 101 + i) for i in range(50)]]
    got = dict(textkit.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 10: 8} | {101 + i: 100 for i in range(50)}


def brute_windows(h, width):
    out = set()
    for c in range(len(h)):
        left = c
        while left and h[left - 1] > h[c]:
            left -= 1
        right = c
        while right + 1 < len(h) and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= width:
            out.add((left, c, right))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=60), max_size=6), st.integers(1, 9))
def test_compact_windows(seqs, width):
    off = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
    got = set(zip(*(x.tolist() for x in substring.compact_windows(np.array([v for s in seqs for v in s], np.uint64), off, width))))
    assert got == {(a + o, c + o, b + o) for s, o in zip(seqs, off.tolist()) for a, c, b in brute_windows(s, width)}


def test_passages(spark, prose):
    rng = random.Random(5)
    shared = [prose(60) for _ in range(6)]
    texts, truth = [], {}
    for i in range(60):
        body = [prose(rng.randint(5, 120))]
        if i % 2 == 0:
            p = rng.randrange(6)
            body.append(shared[p] if i % 4 else edited(rng, shared[p], 0.02))
            truth.setdefault(p, []).append(i)
        texts.append(" ".join([*body, prose(rng.randint(5, 120))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring.near_passages(docs).collect()
    linked = {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}
    wanted = {i for ids in truth.values() if len(ids) > 1 for i in ids}
    assert len(linked & wanted) >= 0.9 * len(wanted)
    assert not linked - wanted
    of = {i: p for p, ids in truth.items() for i in ids}
    assert all(of[r["doc_id"]] == of[r["other_id"]] and r["end"] - r["start"] >= 50 for r in rows)
    for r in rows:
        a, b = texts[r["doc_id"]].split()[r["start"] : r["end"]], texts[r["other_id"]].split()[r["other_start"] : r["other_end"]]
        assert len(set(a) & set(b)) >= 0.6 * len(set(a))


def test_passages_with_other_ids(spark, prose):
    shared, other = prose(60), prose(70)
    rows = [("a", prose(30) + " " + shared), ("b", shared + " " + prose(20)), ("c", other), ("d", other), (None, other), ("e", prose(80))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id string, text string, id int, name string")
    got = {frozenset((r["doc_id"], r["other_id"])) for r in substring.near_passages(docs).collect()}
    assert got == {frozenset("ab"), frozenset("cd")}


def test_passages_of_stock_sentences(spark):
    rng = random.Random(11)
    unique = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    stock = [unique(27) for _ in range(12)]
    chosen = [tuple(rng.sample(range(12), 2)) for _ in range(150)]
    docs = spark.createDataFrame([(i, " ".join([unique(40), stock[a], stock[b], unique(40)])) for i, (a, b) in enumerate(chosen)], "doc_id long, text string")
    linked = set()
    for r in substring.near_passages(docs).collect():
        if chosen[r["doc_id"]] == chosen[r["other_id"]]:
            linked |= {r["doc_id"], r["other_id"]}
    assert linked == {i for i, pair in enumerate(chosen) if chosen.count(pair) > 1}


def found(partner, text):
    words = {w: i + 1 for i, w in enumerate(sorted({*partner.split(), *text.split()}))}
    grams = lambda t: np.array([hash(tuple(words[w] for w in t.split()[i : i + 5])) & (1 << 63) - 1 for i in range(len(t.split()) - 4)], np.uint64)
    return substring.passages(grams(partner), grams(text), 5, 50, 12, 0.6)


@pytest.mark.parametrize("around, every", [(200, 8), (400, 10), (100, 8)])
def test_exact_passage_in_edited_text(around, every):
    text = [f"w{i}" for i in range(2 * around + 60)]
    other = [w if around <= i < around + 60 or i % every else f"x{i}" for i, w in enumerate(text)]
    rows = found(" ".join(text), " ".join(other))
    assert any(lo <= around and around + 60 <= hi and alo <= around and around + 60 <= ahi for lo, hi, alo, ahi, _ in rows)
    assert all(share >= 0.6 for *_, share in rows)


@pytest.mark.parametrize("edited_at", [None, 30])
@pytest.mark.parametrize("before", [True, False])
def test_passage_quoted_elsewhere(before, edited_at):
    p = [f"w{i}" for i in range(60)]
    gap = [f"y{i}" for i in range(40)]
    quote = p[:30] if before else p[30:]
    partner = [*quote, *gap, *p] if before else [*p, *gap, *quote]
    text = [f"new{i}" if i == edited_at else w for i, w in enumerate(p)]
    at = 70 if before else 0
    assert (0, 60, at, at + 60) in {x[:4] for x in found(" ".join(partner), " ".join(text))}


def test_passages_odd(spark, odd_docs):
    got = {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in substring.near_passages(odd_docs).collect()}
    assert got == {(6, 5, 0, 30_000)}


def test_flag_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(fuse, "SENT_BYTES", 0)
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    assert sorted(r[0] for r in fuse.without(docs, spark.range(5).select(F.col("id").alias("h"))).select("doc_id").collect()) == list(range(5, 20))
