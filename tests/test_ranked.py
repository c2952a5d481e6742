"""Matches by rules in order, where many targets match."""

from pyspark.sql import functions as F

from eventloom.operators import incidents, joins


def joined(node):
    """Rows that the joins of a plan give."""
    rows = [node.metrics().get("numOutputRows").get().value()] if "Join" in node.nodeName() else []
    for i in range(node.children().size()):
        rows += joined(node.children().apply(i))
    return rows


def test_targets_of_one_key_meet_a_row_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        schema = "id string, person_name string, date_of_death string"
        some = lambda p, day: spark.createDataFrame([(f"{p}{n:03}", "Ann Lee", day) for n in range(300)], schema)
        full = lambda df: df.select(*[F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in incidents.FIELDS])
        out = incidents.resolve(full(some("i", "2026-01-08")), full(some("e", "2026-01-02")))
        assert sorted(map(tuple, out.collect())) == [(f"i{n:03}", "e000", 4) for n in range(300)]
        assert max(joined(out._jdf.queryExecution().executedPlan())) <= 300
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_ranked_by_rule_then_id_and_unknown_keys(spark):
    rows = spark.createDataFrame([(1, 7, [5, 6]), (2, None, [9]), (3, 8, None), (4, 8, [9, 9, 5]), (4, 8, [5])], "r int, a int, b array<int>")
    targets = spark.createDataFrame([(30, 7, 1), (20, 7, 6), (10, None, 5), (40, 3, 9), (15, 3, 9)], "t int, x int, y int")
    c = F.col
    got = joins.ranked(rows, targets, [[(c("a"), c("x")), (c("b"), c("y"))], [(c("a"), c("x"))], [(c("b"), c("y"))]], "r", "t")
    assert sorted(map(tuple, got.collect())) == [(1, 20, 1), (2, 15, 3), (4, 10, 3)]
