"""Toxicity by averaged subword embeddings and a linear softmax.

A word (a run of letters or digits, without case) is the mean of the vectors of its character n-grams
of 3 to 6, with its ends marked, and of the whole word, each hashed to one of BUCKETS rows; so an unseen
misspelling shares most of its vectors with the word.  The mean over a window of WINDOW words (a shorter one is
filled up with zeros; a word that came within the last WINDOW words is left out) goes to a softmax
of two classes.  Embeddings and softmax are trained jointly with numpy on the labelled documents: a sample of at most
SAMPLE (clean, toxic) documents, the least by a hash of doc_id.  Only whole documents are labelled, so each
later epoch takes as toxic the windows of toxic documents that the model finds
most so.  A document's score is its highest window's; the threshold is set on
a fifth of the sample kept out of training.

Since all is linear up to the softmax, a trained model is one number a bucket, and documents are scored
by one number for each distinct word.

Defined cases: a null or empty text, or one without words, has toxicity 0; very long texts are read whole; a score that ties with
the threshold is not toxic; of repeated rows each has its score, and of rows of one doc_id the first text in order trains, so SAMPLE is a bound.
Labels that are null, or that contradict each other for a doc_id, are not used; without both labels, or with an empty table, all scores are 0.
doc_id may be of any type; other columns, whatever their names, have no influence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .bpe import LETTER, NUMBER, char_classes

BUCKETS, DIM, LOW, HIGH = 1 << 18, 8, 3, 6
WINDOW, STRIDE = 40, 20
SAMPLE = (6000, 3000)
SEGMENTS, EPOCHS, BATCH, RATE, DECAY = 6, 12, 512, 0.4, 0.02
_folded: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Hash of each code point's lower case."""
    if not _folded:
        low = np.arange(0x110000, dtype=np.uint64)
        for c in range(0x24F0):
            x = chr(c).lower()
            if len(x) == 1:
                low[c] = ord(x)
        _folded.append(K.mix(low + np.uint64(1)))
    return _folded[0]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in code points, hashes of the code points, and each document's first word (one more at the end)."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    doc = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[off]
    ink = np.isin(char_classes()[cp], (LETTER, NUMBER))
    edge = np.zeros(len(cp) + 1, bool)
    edge[doc] = True
    prev, nxt = np.zeros(len(cp), bool), np.zeros(len(cp), bool)
    prev[1:], nxt[:-1] = ink[:-1], ink[1:]
    start = np.flatnonzero(ink & (edge[:-1] | ~prev))
    end = np.flatnonzero(ink & (edge[1:] | ~nxt)) + 1
    return start, end, _fold()[cp], np.searchsorted(start, doc)


def word_hashes(start: np.ndarray, end: np.ndarray, cp: np.ndarray) -> np.ndarray:
    up, down = K.powers(len(cp) + 1)
    p = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp * up[: len(cp)], out=p[1:])
    return K.mix((p[end] - p[start]) * down[start])


def spread(inverse: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that don't repeat one of the WINDOW words before, and each document's first of them."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(inverse, kind="stable")
    near = (np.diff(inverse[order]) == 0) & (np.diff(doc[order]) == 0) & (np.diff(order) <= WINDOW)
    keep = np.ones(len(inverse), bool)
    keep[order[1:][near]] = False
    return np.flatnonzero(keep), np.concatenate([[0], np.cumsum(keep)])[first]


def ngrams(start: np.ndarray, end: np.ndarray, cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words end to end, and each word's first (one more at the end)."""
    n = end - start + 2
    off = np.concatenate([[0], np.cumsum(n)])
    marked = np.empty(off[-1], np.uint64)
    marked[off[:-1]], marked[off[1:] - 1] = np.uint64(0x3C3C3C), np.uint64(0x3E3E3E)
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    size = end - start
    marked[inner] = cp[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    up, down = K.powers(len(marked) + 1)
    p = np.zeros(len(marked) + 1, np.uint64)
    np.cumsum(marked * up[: len(marked)], out=p[1:])
    word_end = np.repeat(off[1:], n)
    at = np.arange(len(marked))
    found, owner = [K.mix((p[off[1:]] - p[off[:-1]]) * down[off[:-1]])], [np.arange(len(n))]
    who = np.repeat(np.arange(len(n)), n)
    for k in range(LOW, HIGH + 1):
        s = at[(at + k <= word_end) & ~((n[who] == k) & (at == off[who]))]
        found.append(K.mix((p[s + k] - p[s]) * down[s]))
        owner.append(who[s])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    bucket = (np.concatenate(found)[order] >> np.uint64(64 - 18)).astype(np.int64) % BUCKETS
    return bucket, np.searchsorted(owner[order], np.arange(len(n) + 1))


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, word after the last) of all windows; documents without words have none."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[doc] + k * STRIDE
    return doc, begin, np.minimum(begin + WINDOW, first[doc + 1])


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: what it adds to the logit
    bias: float
    threshold: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Highest window probability of each document."""
        out = np.zeros(len(off) - 1)
        start, end, cp, first = words(buf, off)
        if not len(start):
            return out
        _, sample, inverse = np.unique(word_hashes(start, end, cp), return_index=True, return_inverse=True)
        bucket, o = ngrams(start[sample], end[sample], cp)
        each = np.add.reduceat(self.weight[bucket], o[:-1]) / np.diff(o)
        kept, first = spread(inverse, first)
        upto = np.concatenate([[0], np.cumsum(each[inverse[kept]])])
        doc, a, b = windows(first)
        z = (upto[b] - upto[a]) / WINDOW + self.bias
        np.maximum.at(out, doc, 1 / (1 + np.exp(-np.clip(z, -50, 50))))
        return out


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.text_bytes(pa.array(texts, pa.large_string()))


def vocabulary(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word of each word, each text's first word, buckets of the distinct words end to end and their offsets.

    Texts are read a few hundred at a time, so that only numbers are kept of them.
    """
    hashes, counts, keys, grams, sizes = [], [], [], [], []
    known = np.zeros(0, np.uint64)
    for at in range(0, len(texts), 256):
        start, end, cp, first = words(*_column(texts[at : at + 256]))
        h = word_hashes(start, end, cp)
        hashes.append(h)
        counts.append(np.diff(first))
        u, sample = np.unique(h, return_index=True)
        new = ~np.isin(u, known)
        bucket, o = ngrams(start[sample[new]], end[sample[new]], cp)
        keys.append(u[new])
        grams.append(bucket.astype(np.int32))
        sizes.append(np.diff(o))
        known = np.union1d(known, u)
    every = np.concatenate(keys)
    order = np.argsort(every)
    word = order[np.searchsorted(every[order], np.concatenate(hashes))].astype(np.int32)
    return word, np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(grams), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def train(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit embeddings and softmax jointly on documents labelled 0 or 1; see the module's text."""
    labels = np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -50.0, 0.5)
    rng = np.random.default_rng(seed)
    word, first, bucket, o = vocabulary(texts)
    kept, first = spread(word, first)
    word = word[kept]
    held = rng.random(len(texts)) < 0.2
    doc, a, b = windows(first)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) * np.float32(1e-3)  # n-grams never met say next to nothing
    soft = (rng.random((DIM, 2)) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen = np.full(BUCKETS, 1e-4, np.float32)
    seen_soft = np.full((DIM, 2), 1e-4, np.float32)

    def forward(w: np.ndarray, rows: np.ndarray):
        """Windows w: mean vectors, with what the backward pass needs."""
        n = b[w] - a[w]
        flat = np.repeat(a[w] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        u, inv = np.unique(word[flat], return_inverse=True)
        m = o[u + 1] - o[u]
        grams = bucket[np.repeat(o[u] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        head = np.cumsum(m) - m
        vec = np.add.reduceat(rows[grams], head, axis=0) / m[:, None].astype(np.float32)
        mean = np.add.reduceat(vec[inv], np.cumsum(n) - n, axis=0) / np.float32(WINDOW)
        return mean, n, u, inv, m, grams

    def logit(w: np.ndarray) -> np.ndarray:
        scalar = emb @ (soft[:, 1] - soft[:, 0])
        each = np.add.reduceat(scalar[bucket], o[:-1]) / np.diff(o)
        upto = np.concatenate([[0], np.cumsum(each[word].astype(np.float64))])
        return (upto[b[w]] - upto[a[w]]) / WINDOW + bias[1] - bias[0]

    everything = np.arange(len(doc))
    for epoch in range(EPOCHS):
        emb *= np.float32(1 - DECAY)
        order = rng.permutation(everything[~held[doc]])
        z = logit(order) if epoch else rng.random(len(order))
        # of toxic documents the windows that look most toxic, of clean ones half of those and half at random
        rank_by = np.where((labels[doc[order]] == 1) | (rng.random(len(order)) < 0.5), z, rng.normal(size=len(order)))
        order = order[np.lexsort((-rank_by, doc[order]))]
        d = doc[order]
        nth = np.arange(len(d)) - np.searchsorted(d, d)
        size = np.searchsorted(d, d, "right") - np.searchsorted(d, d)
        most = np.where(labels[d] == 1, np.maximum(1, np.ceil(size / (1 + epoch))), SEGMENTS)
        chosen = rng.permutation(order[nth < np.minimum(most, SEGMENTS)])
        y_all = labels[doc[chosen]]
        share = np.bincount(y_all, minlength=2) / len(y_all)
        balance = (0.5 / np.maximum(share, 1e-6)).astype(np.float32)
        step = min(BATCH, max(16, len(chosen) // 40))
        for at in range(0, len(chosen), step):
            w = chosen[at : at + step]
            y = labels[doc[w]]
            mean, n, u, inv, m, grams = forward(w, emb)
            s = mean @ soft + bias
            s = np.exp(s - s.max(1, keepdims=True))
            g = s / s.sum(1, keepdims=True)
            g[np.arange(len(w)), y] -= 1
            g *= balance[y][:, None]
            g_soft = mean.T @ g / len(w)
            g_mean = (g @ soft.T) / WINDOW
            seg = np.repeat(np.arange(len(w)), n)
            g_word = np.stack([np.bincount(inv, weights=g_mean[seg, k], minlength=len(u)) for k in range(DIM)], 1) / m[:, None]
            owner = np.repeat(np.arange(len(u)), m)
            ug, gi = np.unique(grams, return_inverse=True)
            g_emb = np.stack([np.bincount(gi, weights=g_word[owner, k], minlength=len(ug)) for k in range(DIM)], 1)
            seen[ug] += (g_emb**2).mean(1)
            emb[ug] -= (RATE * g_emb / np.sqrt(seen[ug])[:, None]).astype(np.float32)
            seen_soft += g_soft**2
            soft -= (RATE * 0.2 * g_soft / np.sqrt(seen_soft)).astype(np.float32)
            bias -= (RATE * g.mean(0)).astype(np.float32)
    scalar = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
    model = Model(scalar, float(bias[1] - bias[0]), 0.5)
    test = held if 0 < labels[held].sum() < held.sum() else np.ones(len(texts), bool)
    held_texts = [t for t, h in zip(texts, test) if h]
    scores = [model.scores(*_column(held_texts[i : i + 256])) for i in range(0, len(held_texts), 256)]
    model.threshold = best_threshold(np.concatenate(scores), labels[test])
    return model


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Where F0.5 is best, since clean documents are many more than in the sample; in the middle of the gap."""
    order = np.argsort(-score)
    s, t = score[order], y[order]
    hit = np.cumsum(t)
    f = 1.25 * hit / (np.arange(len(t)) + 1 + 0.25 * t.sum())
    f[:-1][s[:-1] == s[1:]] = -1
    i = int(np.argmax(f))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def labelled(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """(text, toxic) of the sample: so many documents a label at most, the least by hash of doc_id."""
    one = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    one = one.where("toxic = other").select("doc_id", "toxic")
    least = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y]) for y in (0, 1)]
    chosen = least[0].union(least[1])
    texts = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return texts.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> Model:
    t = labelled(docs, labels, sample).toArrow()
    return train(t["text"].to_pylist(), t["toxic"].to_numpy().astype(np.int64))


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """One row a document: doc_id, toxicity (highest window's probability), toxic."""
    docs = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in K.chunks(batches):
            s = m.scores(*K.text_bytes(b.column(1)))
            yield pa.record_batch([b.column(0), pa.array(np.round(s, 6)), pa.array(s > m.threshold)], ["doc_id", "toxicity", "toxic"])

    return docs.mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean")
