"""Texts far longer than news usually has."""

import random
import re

from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.plans import extract


def test_extract_from_long_clauses(spark):
    rng = random.Random(5)
    words = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    df = spark.createDataFrame([("a", f"Ann Lee was {words}."), ("b", f"Ann Lee {words} was at the gate was at the gate {words}.")], "k string, t string")
    got = {r["k"]: r["what"] for r in extract.triplets(df, "k", "t").collect()}
    assert got == {"a": f"was {words}", "b": f"{words} was at the gate {words}"}


def test_repeats_of_long_texts_as_by_the_plain_pattern(spark):
    rng = random.Random(6)
    plain = re.compile(r"\b((?:\w+\s+){2,}\w+)\s+\1\b", re.I | re.A)
    rows = []
    for size in (1, 2, 3, 4, 7, 8, 9, 12, 40):
        for _ in range(8):
            w = lambda n: [f"{rng.choice('aAbBc')}{rng.randrange(40)}" for _ in range(n)]
            part = w(size)
            rows.append((" ".join(w(150) + part + part + w(rng.randrange(90)) + ["x-y,"] + part + part + part),))
    got = spark.createDataFrame(rows, "t string").select("t", text.drop_repeat_phrase(F.col("t")).alias("x")).collect()
    assert [r["x"] for r in got] == [plain.sub(r"\1", r["t"]) for r in got]
