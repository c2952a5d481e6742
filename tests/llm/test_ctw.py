"""Context-tree weighting against a bit-by-bit recursion over nested dictionaries."""

import math
import random

import numpy as np
import pytest

from eventloom.llm import ctw


def kt(n0, n1):
    out = 0.0
    a = b = 0
    for _ in range(n0):
        out += math.log((a + 0.5) / (a + b + 1))
        a += 1
    for _ in range(n1):
        out += math.log((b + 0.5) / (a + b + 1))
        b += 1
    return out


class Brute:
    def __init__(self, texts, depth):
        self.depth, self.n = depth, {}
        for t in texts:
            for i, b in enumerate(t):
                past = [t[i - d] if i - d >= 0 else 0 for d in range(1, depth + 1)]
                for bit in range(8):
                    prefix = (bit, b >> (8 - bit))
                    for d in range(depth + 1):
                        c = self.n.setdefault((prefix, tuple(past[:d])), [0, 0])
                        c[b >> (7 - bit) & 1] += 1

    def log_pw(self, prefix, past):
        own = kt(*self.n[prefix, past])
        if len(past) == self.depth:
            return own
        below = sum(self.log_pw(prefix, past + (b,)) for b in range(256) if (prefix, past + (b,)) in self.n)
        return np.logaddexp(own, below) - math.log(2)

    def one(self, prefix, past, d=0):
        node = (prefix, past[:d])
        if node not in self.n:
            return 0.5
        n0, n1 = self.n[node]
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if d == self.depth:
            return own
        below = sum(self.log_pw(prefix, past[:d] + (b,)) for b in range(256) if (prefix, past[:d] + (b,)) in self.n)
        w = 1 / (1 + math.exp(-(kt(n0, n1) - below)))
        return w * own + (1 - w) * self.one(prefix, past, d + 1)

    def apart(self, t):
        """Bits of a text of the corpus, each byte under all others: the root's Pw with and without it."""
        total = 0.0
        for i, b in enumerate(t):
            past = tuple(t[i - d] if i - d >= 0 else 0 for d in range(1, self.depth + 1))
            for bit in range(8):
                prefix, value = (bit, b >> (8 - bit)), b >> (7 - bit) & 1
                full = self.log_pw(prefix, ())
                for d in range(self.depth + 1):
                    self.n[prefix, past[:d]][value] -= 1
                total -= (full - self.log_pw(prefix, ())) / math.log(2)
                for d in range(self.depth + 1):
                    self.n[prefix, past[:d]][value] += 1
        return total

    def bits(self, t):
        total = 0.0
        for i, b in enumerate(t):
            past = tuple(t[i - d] if i - d >= 0 else 0 for d in range(1, self.depth + 1))
            for bit in range(8):
                p = self.one((bit, b >> (8 - bit)), past)
                total -= math.log2(p if b >> (7 - bit) & 1 else 1 - p)
        return total


TEXTS = ["abracadabra", "the cat", "", "été à la mer", None, "abracadabra", "ab" * 20]


def check(got, want):
    assert [(g["doc_id"], g["n_bytes"]) for g in got] == [(i, len((t or "").encode())) for i, t in enumerate(TEXTS)]
    for g, t in zip(got, TEXTS):
        if not t:
            assert g["bits_per_byte"] is None
        else:
            assert g["bits_per_byte"] == pytest.approx(want(t.encode()) / len(t.encode()), abs=2e-4)


@pytest.mark.parametrize("depth", [3, 6])
@pytest.mark.parametrize("size", [1 << 20, 7])
def test_against_brute_force(spark, monkeypatch, depth, size):
    monkeypatch.setattr(ctw, "CHUNK_BYTES", size)  # several chunks and parts
    monkeypatch.setattr(ctw, "PART_BYTES", size)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    brute = Brute([t.encode() for t in TEXTS if t], depth)
    check(sorted(ctw.score_corpus(docs, depth, leave_out=False).collect()), brute.bits)
    check(sorted(ctw.score_corpus(docs, depth).collect()), brute.apart)


def test_unseen_contexts(spark):
    train = spark.createDataFrame([(1, "abab abab"), (2, "xyz")], "doc_id long, text string")
    other = spark.createDataFrame([(1, "xab zzz"), (2, "☃")], "doc_id long, text string")
    for depth in (3, 6):
        brute = Brute([b"abab abab", b"xyz"], depth)
        got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score(other, ctw.train(train, depth), depth).collect()}
        for i, t in ((1, "xab zzz"), (2, "☃")):
            assert got[i] == pytest.approx(brute.bits(t.encode()) / len(t.encode()), abs=2e-4)


def test_texts_that_stand_twice_cost_less(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:10]])), "doc_id long, text string")
    got = {r["doc_id"]: r["bits_per_byte"] for r in ctw.score_corpus(docs).collect()}
    assert max(got[i] for i in range(10)) < min(got[i] for i in range(10, 60))
    assert all(got[i] == got[60 + i] for i in range(10))


def test_empty_and_odd(spark, odd_docs, no_docs):
    assert ctw.score_corpus(no_docs).count() == 0
    rows = ctw.score_corpus(odd_docs).collect()
    assert len(rows) == 12
    assert {(r["doc_id"], r["bits_per_byte"] is None) for r in rows} == {(1, True), (2, True), (3, False), (None, False), (5, False), (6, False), (7, False), (8, False), (None, True), (9, True), (10, False)}
    assert len({r["bits_per_byte"] for r in rows if r["doc_id"] in (5, 6)}) == 1
