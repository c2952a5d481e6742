"""Quality rules as weak supervision.

Each rule votes good (2), bad (1) or abstains (0).  The votes of a document form
one number in base 3, so that all the corpus holds for estimation is a count for
each vote pattern: at most 3**rules rows, however many documents there are.
Expectation-maximisation over these counts estimates each rule's accuracies and the
share of good documents; a document's posterior probability then decides.

Defined cases: a null or blank text has no words, on which every rule but the
length rule abstains, so it is judged by that rule and the share of good documents; a very long text is
measured whole; a posterior that ties with the threshold keeps the document.  Each repeated row has a row and counts in
the estimate; nulls in other columns, extra columns and their names have no influence.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K

STOP = (
    "the of and to in a is that it for on was be with as by at this are from or an "
    "de la le les des et en un une du que est pour dans qui sur pas par au avec "
    "der die und das den von zu mit sich ein eine ist auf nicht im dem für als auch "
    "el los las y del se por con su para una no al lo como más"
).split()


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SYMBOL, PUNCT = _flags("#$%&*=<>^~{}\\|@_"), _flags("!?#$%&*.,;:")
UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def hash_of(words: list[str]) -> np.ndarray:
    h, _ = K.word_hashes(pa.array([" ".join(words)]))
    return np.sort(h)


STOP_HASHES, BAR = hash_of(STOP), hash_of(["|"])[0]


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    """Numbers that the rules look at, one of each a document.

    words, chars (other than white space), symbols, runs (a punctuation mark after the same mark), capitals
    (Latin and Cyrillic), distinct words, repeats (a word after the same word), stop words, bars.
    """
    buf, off = K.text_bytes(column)
    start, end, first = K.word_spans(buf, off)
    wh = K.span_hash(K.prefix_hash(buf), start, end)

    def by_byte(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[off])

    def by_word(flag: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flag)])[first])

    before = np.zeros(len(buf), np.uint8)
    before[1:] = buf[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = 0
    n_docs = len(off) - 1
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64), np.diff(first))
    key = np.sort((doc << np.uint64(40)) | (wh >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    again = np.zeros(len(wh), bool)
    again[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    at = np.minimum(np.searchsorted(STOP_HASHES, wh), len(STOP_HASHES) - 1)
    accented = ((before == 0xC3) & (buf >= 0x80) & (buf <= 0x9E)) | ((before == 0xD0) & (buf >= 0x90) & (buf <= 0xAF))
    return {
        "n": np.diff(first),
        "c": by_byte(~K.SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "sym": by_byte(SYMBOL[buf]),
        "runs": by_byte(PUNCT[buf] & (before == buf)),
        "up": by_byte(UPPER[buf] | accented),
        "u": np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n_docs),
        "same": by_word(again),
        "stop": by_word(STOP_HASHES[at] == wh),
        "bar": by_word(wh == BAR),
    }


def rules(m: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(name, votes good, votes bad) over measures()."""
    n, chars = m["n"], m["c"]
    enough = n >= 20
    return [
        ("length", n >= 30, n < 4),
        ("symbols", (n > 0) & (m["sym"] < 0.01 * chars), (n > 0) & (m["sym"] > 0.05 * chars)),
        ("bangs", enough & (m["runs"] < 0.01 * n), (n >= 5) & (m["runs"] > 0.2 * n)),
        ("capitals", enough & (m["up"] < 0.15 * chars), (n >= 5) & (m["up"] > 0.4 * chars)),
        ("variety", enough & (m["u"] > 0.4 * n), enough & (m["u"] < 0.1 * n)),
        ("repeats", enough & (m["same"] < 0.05 * n), enough & (m["same"] > 0.3 * n)),
        ("function_words", enough & (m["stop"] > 0.08 * n), enough & (m["stop"] < 0.02 * n)),
        ("table_bars", enough & (m["bar"] < 0.02 * n), enough & (m["bar"] > 0.2 * n)),
        ("word_length", enough & (chars > 3.5 * n) & (chars < 14 * n), (n > 0) & ((chars < 2 * n) | (chars > 30 * n))),
    ]


NAMES = [name for name, *_ in rules({k: np.zeros(0) for k in "n c sym runs up u same stop bar".split()})]


def votes(column: pa.Array) -> np.ndarray:
    """The vote pattern of each text."""
    code = np.zeros(len(column), np.int64)
    for i, (_, good, bad) in enumerate(rules(measures(column))):
        code += np.where(good, 2, np.where(bad, 1, 0)) * 3**i
    return code


def estimate(patterns: list[tuple[int, int]], n_rules: int, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Accuracies of each rule on good and on bad documents, and the share of good ones, by EM over (pattern, count).

    Row 0 is P(votes good | good, votes), row 1 P(votes bad | bad, votes); abstaining says nothing.  Nothing bounds
    the estimates but one pseudo-vote each way.  The start is a majority vote in which a vote weighs
    by its rarity, -log of the share of the rule's votes that go its way; this also fixes which class is which, and which of
    several optima is found.
    """
    if not patterns:
        return np.full((2, n_rules), 0.5), 0.5
    code, count = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    votes = code[:, None] // 3 ** np.arange(n_rules) % 3
    good, bad = votes == 2, votes == 1
    share = (count @ bad + 1) / (count @ (good | bad) + 2)
    post = 1 / (1 + np.exp((good * np.log1p(-share) - bad * np.log(share)).sum(1)))
    for _ in range(rounds):
        acc = np.stack([(w @ vote + 1) / (w @ (good | bad) + 2) for vote, w in ((good, post * count), (bad, (1 - post) * count))])
        pi = float((post @ count + 1) / (count.sum() + 2))
        before, post = post, posterior(votes, acc, pi)
        if np.abs(post - before).max() < 1e-9:
            break
    return acc, pi


def posterior(votes: np.ndarray, acc: np.ndarray, pi: float) -> np.ndarray:
    up = np.log(acc[0]) - np.log1p(-acc[1])
    down = np.log1p(-acc[0]) - np.log(acc[1])
    z = np.log(pi) - np.log1p(-pi) + ((votes == 2) * up + (votes == 1) * down).sum(1)
    return 1 / (1 + np.exp(-z))


def _coder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.chunks(batches):
        yield pa.record_batch([*b.columns[:-1], pa.array(votes(b.column(b.num_columns - 1)))], [*b.schema.names[:-1], "code"])


def model(codes: DataFrame) -> dict[int, float]:
    """The posterior of each vote pattern in the column code.  The driver holds vote patterns only (3**9 at most)."""
    found = codes.groupBy("code").agg(F.count("*").alias("n")).collect()
    patterns = sorted((r["code"], r["n"]) for r in found)
    a, pi = estimate(patterns, len(NAMES))
    codes = np.array([c for c, _ in patterns], np.int64)
    probs = posterior(codes[:, None] // 3 ** np.arange(len(NAMES)) % 3, a, pi) if len(codes) else np.zeros(0)
    return dict(zip(codes.tolist(), np.round(probs, 9).tolist()))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row a document: doc_id, votes by rule (1 good, 0 bad, null abstains), posterior, keep.

    Texts are measured once; the votes, as one number a row, are written and read for the estimate and the result.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    coded = K.materialize(docs.mapInArrow(_coder, f"doc_id {kind}, code long"), "votes")
    known = docs.sparkSession.createDataFrame(sorted(model(coded).items()), "code long, posterior double")
    each = [(F.nullif(F.expr(f"pmod(div(code, {3**i}), 3)"), F.lit(0)) - 1).cast("int").alias(f"vote_{k}") for i, k in enumerate(NAMES)]
    return coded.join(known, "code").select("doc_id", *each, "posterior", (F.col("posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose posterior reaches the threshold, with the columns of docs."""
    known = model(docs.select("text").mapInArrow(_coder, "code long"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.chunks(batches):
            code = votes(b.column(b.schema.get_field_index("text")))
            yield b.filter(pa.array([known[c] >= threshold for c in code.tolist()], pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)
