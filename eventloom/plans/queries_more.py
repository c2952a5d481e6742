"""More queries of the kind of queries.py, in the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, structured, text
from ..operators import actors
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import joins as J
from ..operators import merge as M
from ..operators import select as S
from ..sources import feeds
from .queries import _HOST, query, show, t

# sorts and limits; the limit makes the order count


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderpriority FROM orders ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END DESC, o_orderpriority, o_orderkey LIMIT 40")
def sort_date_name(spark, sf_dir):
    o = t(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = o.withColumns({"when_": F.when(F.col("o_orderkey") % 7 != 0, F.col("d")), "name": F.concat_ws(" ", "o_orderpriority", F.format_string("%012d", "o_orderkey"))})
    return S.by_date_then_name(o, "when_", "name").limit(40).select("o_orderkey", "d", "o_orderpriority")


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS state FROM supplier ORDER BY CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR) END, CAST(s_suppkey % 3 AS VARCHAR), s_name LIMIT 12")
def sort_state_city_name(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").withColumns({"state": F.col("s_nationkey").cast("string"), "city": (F.col("s_suppkey") % 3).cast("string")})
    return S.by_place(s.withColumn("given", F.when(F.col("s_suppkey") % 5 != 0, F.col("state"))), "given", "city", "s_name").limit(12).select("s_suppkey", "state")


def _stories_sorted(option: str, order: str) -> None:
    def run(spark, sf_dir):
        o = t(spark, sf_dir, "orders").withColumn("d", F.when(F.col("o_custkey") % 11 != 0, F.col("o_orderdate")))
        g = o.groupBy("o_custkey").agg(F.max("d").alias("published"), F.count("*").alias("items"))
        return S.stories_sorted(g, option, "published", "items", "o_custkey").limit(30).select("o_custkey", "items")

    run.__name__ = f"stories_{option}"
    query(f"SELECT o_custkey, items FROM (SELECT o_custkey, max(CASE WHEN o_custkey % 11 <> 0 THEN o_orderdate END) AS published, count(*) AS items FROM orders GROUP BY 1) ORDER BY {order}, o_custkey LIMIT 30")(run)


for _option, _order in (("newest", "published DESC NULLS LAST"), ("oldest", "published ASC NULLS FIRST"), ("coverage", "items DESC")):
    _stories_sorted(_option, _order)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 48")
def sort_page(spark, sf_dir):
    return S.page_of(t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 2, 24)


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 50 = 9 THEN NULL ELSE text END AS text FROM documents) SELECT doc_id, 'longest' AS sample FROM (SELECT doc_id FROM d ORDER BY length(coalesce(text, '')) DESC, doc_id LIMIT 20) "
    "UNION ALL SELECT doc_id, 'empty' FROM (SELECT doc_id FROM d WHERE coalesce(text, '') = '' ORDER BY doc_id LIMIT 1)"
)
def longest_and_empty(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 50 = 9 THEN NULL ELSE text END AS text"))
    return S.longest_texts(d, "text", "doc_id", 20).select("doc_id", "sample")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def link_cap(spark, sf_dir):
    return S.first_distinct(t(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], 50).select("o_custkey", "o_orderkey")


@query("SELECT event_id FROM events WHERE user_id = (SELECT arg_max(user_id, (t, -user_id)) FROM (SELECT user_id, max(ts) AS t FROM events GROUP BY 1))")
def latest_run(spark, sf_dir):
    return S.latest_run(t(spark, sf_dir, "events"), "user_id", "ts").select("event_id")


# filters


@query("SELECT event_id FROM events WHERE NOT (event_type LIKE '%ign%' AND props LIKE '%1%' AND user_id < 500)")
def like_delete(spark, sf_dir):
    return S.unlike(t(spark, sf_dir, "events"), {"event_type": "%ign%", "props": "%1%"}, F.col("user_id") < 500).select("event_id")


@query(r"SELECT p_partkey, regexp_matches(p_name, '(?i)\b(?:widget|co.*t|small)\b') AS x FROM part")
def keyword_pattern(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").rlike(text.alternation(["widget", "co*t", "Small"])).alias("x"))


@query("SELECT doc_id, length(text) >= 400 OR contains(source, 'site0') AS x FROM documents")
def minimum_length_gate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", C.long_enough(F.col("source"), F.col("text"), ["site0"], 400).alias("x"))


def _event_filter(name: str, which: str, with_unrest: bool, sql: str) -> None:
    def run(spark, sf_dir):
        labels = F.create_map(*[F.lit(x) for x in ("click", "march", "view", "riot", "purchase", "vigil", "error", "raid")])
        e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.try_element_at(labels, F.col("event_type"))).alias("types"))
        return e.select("user_id", C.in_event_filter(F.col("types"), which, with_unrest).alias("x"))

    run.__name__ = name
    query(f"SELECT user_id, {sql} AS x FROM events GROUP BY 1")(run)


_event_filter("event_filter_map", "protest", True, "bool_or(event_type IN ('click', 'purchase', 'view'))")
_event_filter("event_filter_headlines", "protest", False, "bool_or(event_type IN ('click', 'purchase'))")
_event_filter("event_filter_single", "raid", True, "bool_or(event_type = 'error')")
_event_filter("event_filter_all", "all", True, "true")


@query(
    "SELECT c_custkey, lat IS NULL OR coalesce(lower(trim(place)) IN ('united states', 'usa', 'nationwide', 'unknown'), false) OR abs(lat - 39.8283) <= 0.1 AND abs(lon + 98.5795) <= 0.1 OR abs(lat - 38.9072) <= 0.15 AND abs(lon + 77.0369) <= 0.15 AS general "
    "FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 39.8 WHEN 2 THEN 38.9 ELSE c_acctbal / 100 END AS lat, CASE c_custkey % 6 WHEN 1 THEN -98.5 WHEN 2 THEN -77.1 ELSE -90.0 END AS lon, CASE c_custkey % 6 WHEN 3 THEN ' USA ' WHEN 4 THEN NULL ELSE c_name END AS place FROM customer)"
)
def precision_partition(spark, sf_dir):
    c = t(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 39.8D WHEN 2 THEN 38.9D ELSE c_acctbal / 100 END AS lat",
        "CASE c_custkey % 6 WHEN 1 THEN -98.5D WHEN 2 THEN -77.1D ELSE -90.0D END AS lon",
        "CASE c_custkey % 6 WHEN 3 THEN ' USA ' WHEN 4 THEN NULL ELSE c_name END AS place",
    )
    return c.select("c_custkey", geo.is_general(F.col("lat"), F.col("lon"), F.col("place")).alias("general"))


# joins


@query(
    "WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN 'new ' ELSE '' END || p_name AS place FROM part), k AS (SELECT * FROM (VALUES (1, 'widget', 10.0, -80.0), (2, 'cold', 20.0, -81.0), (0, 'small', 30.0, -82.0)) v(position, key, lat, lon)), "
    r"m AS (SELECT place, min(position) AS position FROM (SELECT DISTINCT place FROM p), k WHERE regexp_matches(place, '(?:^|[^\p{L}\p{N}_])' || key || '(?:[^\p{L}\p{N}_]|$)') AND NOT (key = 'small' AND contains(place, 'new small')) GROUP BY 1) "
    "SELECT p_partkey, lat, lon, CASE WHEN position IS NOT NULL THEN 'manual' END AS status FROM p LEFT JOIN m USING (place) LEFT JOIN k USING (position)"
)
def manual_coordinates(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 4 == 0, "New ").otherwise(""), "p_name").alias("place"))
    points = spark.createDataFrame([(1, "widget", 10.0, -80.0), (2, "cold", 20.0, -81.0), (0, "small", 30.0, -82.0)], "position int, key string, lat double, lon double")
    return J.manual_point(p, "place", points, {"small": "new small"}).select("p_partkey", "lat", "lon", "status")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'Reader' WHEN event_type = 'purchase' THEN 'Buyer' WHEN user_id % 5 = 0 THEN '  ' ELSE event_type END AS who FROM events")
def actor_aliases(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_type IN ('click', 'view', 'purchase') THEN upper(event_type) || ' ' WHEN user_id % 5 = 0 THEN '  ' ELSE event_type END AS who"))
    aliases = spark.createDataFrame([("click", "Reader"), ("View", "Reader"), ("purchase", "Buyer")], "alias string, display string")
    return actors.aliased(e, "who", aliases)


_EDITED = "(SELECT event_id, ts, user_id, CASE WHEN event_type = 'view' THEN 'click' ELSE event_type END AS who, CASE WHEN event_id % 3 <> 0 THEN ts END AS extracted FROM events)"


@query(f"SELECT event_id, who FROM {_EDITED} QUALIFY row_number() OVER (PARTITION BY user_id, who ORDER BY extracted DESC NULLS LAST, event_id) = 1")
def normalise_and_dedupe(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("who"), F.when(F.col("event_id") % 3 != 0, F.col("ts")).alias("extracted"))
    return actors.rewritten(e, {"who": F.when(F.col("who") == "view", "click")}, ["user_id", "who"], "extracted", "event_id").select("event_id", "who")


@query("SELECT event_id FROM events e WHERE NOT (value < 60 AND EXISTS (SELECT 1 FROM events d WHERE d.value >= 60 AND d.user_id = e.user_id AND left(d.event_type, 3) = left(e.event_type, 3)))")
def completed_actions(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("who", F.concat(F.lit(" User"), "user_id"))
    return actors.without_unfinished(e, "who", F.left("event_type", F.lit(3)), F.col("value") < 60).select("event_id")


@query(
    "SELECT c_custkey, r.label FROM customer LEFT JOIN (SELECT k, arg_min(label, pos) AS label FROM (SELECT s_suppkey AS pos, s_name AS label, unnest([CAST(s_suppkey * 3 AS VARCHAR), CAST(s_nationkey AS VARCHAR)]) AS k FROM supplier) GROUP BY 1) r ON r.k = CAST(c_custkey % 40 AS VARCHAR)"
)
def article_by_either_key(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).cast("string").alias("wanted"))
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("label"), (F.col("s_suppkey") * 3).cast("string").alias("url"), F.col("s_nationkey").cast("string").alias("source_id"))
    return J.by_either_key(c, "wanted", s, ["url", "source_id"], "pos", ["label"]).select("c_custkey", "label")


@query(
    "WITH s AS (SELECT s_suppkey, 'u' || s_suppkey AS url, 's' || s_nationkey AS story, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS body FROM supplier), a AS (SELECT url, body FROM s WHERE body IS NOT NULL), b AS (SELECT story, arg_min(body, s_suppkey) AS body FROM s WHERE body IS NOT NULL GROUP BY 1) "
    "SELECT c_custkey, coalesce(a.body, b.body) AS body FROM customer LEFT JOIN a ON a.url = 'u' || (c_custkey % 90) LEFT JOIN b ON b.story = 's' || c_nationkey"
)
def text_by_url_else_story(spark, sf_dir):
    c = t(spark, sf_dir, "customer").selectExpr("c_custkey", "'u' || (c_custkey % 90) AS url", "'s' || c_nationkey AS story")
    s = t(spark, sf_dir, "supplier").selectExpr("s_suppkey", "'u' || s_suppkey AS url", "'s' || s_nationkey AS story", "CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS body")
    return J.by_first_key(c, ["url", "story"], s, "body", "s_suppkey").select("c_custkey", "body")


@query(
    "WITH g AS (SELECT lower(n_name) AS city, list_sort(list_distinct(list(CAST(s_nationkey % 3 AS VARCHAR) || x))) AS states FROM nation JOIN supplier ON s_nationkey = n_nationkey, (SELECT unnest(['a', 'b']) AS x) WHERE n_nationkey < 15 GROUP BY 1) "
    "SELECT c_custkey, unnest(coalesce(states, [NULL])) AS state FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN g ON g.city = lower(n_name)"
)
def city_states_exploded(spark, sf_dir):
    n = t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    s = t(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey < 15")
    state = F.explode(F.array(F.lit("a"), F.lit("b")))
    g = s.select(F.lower("n_name").alias("city"), "s_nationkey", state.alias("x")).groupBy("city").agg(F.array_sort(F.collect_set(F.concat((F.col("s_nationkey") % 3).cast("string"), "x"))).alias("states"))
    c = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat(F.lit(" "), "n_name").alias("city"))
    return J.city_states(c, "city", g).select("c_custkey", "state")


# aggregates and windows


@query("SELECT o_orderkey, coalesce(strftime(o_orderdate, '%Y-%m') <> lag(strftime(o_orderdate, '%Y-%m')) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS month_change FROM orders")
def month_change(spark, sf_dir):
    return A.month_changes(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_orderkey", "month_change")


@query(
    r"WITH c AS (SELECT p_type, term, i, sum(len(regexp_extract_all(p_name, '(?i)\b' || term || '\b'))) AS n FROM part, (VALUES ('widget', 0), ('cold', 1), ('small', 2), ('nothing', 3)) v(term, i) GROUP BY ALL) "
    "SELECT p_type, CASE WHEN max(n) > 0 THEN arg_max(term, (n, -i)) END AS term, CAST(max(n) AS BIGINT) AS n FROM c GROUP BY 1"
)
def most_mentioned(spark, sf_dir):
    return A.most_mentioned(t(spark, sf_dir, "part"), "p_type", "p_name", ["widget", "cold", "small", "nothing"])


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(sum(CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS n FROM orders GROUP BY 1, 2")
def monthly_sum(spark, sf_dir):
    n = F.when(F.col("o_orderkey") % 9 == 0, "none").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return A.summed(t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), n.alias("n")), ["y", "m"], "n")


_MEASURES = [f"b{i}" for i in range(15)]


@query(
    "WITH f AS (SELECT user_id, min(ts) AS ts, " + ", ".join(f"bool_or(value % 15 >= {i} AND event_type <> 'error') AS b{i}" for i in range(15)) + " FROM events GROUP BY 1) SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (b{i}) AS n_b{i}, CASE WHEN count(*) >= 5 THEN round(count(*) FILTER (b{i}) / count(*), 6) ELSE 0.0 END AS rate_b{i}" for i in range(15))
    + " FROM f GROUP BY 1"
)
def weekly_measures(spark, sf_dir):
    flags = {f"b{i}": (F.col("value") % 15 >= i) & (F.col("event_type") != "error") for i in range(15)}
    folded = A.fold_flags(t(spark, sf_dir, "events"), "user_id", flags, "ts")
    return A.weekly(folded, "ts", _MEASURES).withColumn("week", F.col("week").cast("string"))


@query("SELECT c_nationkey, least(18.0, round(6.0 + 2.0 * log2(count(*) + 1), 6)) AS radius FROM customer GROUP BY 1")
def marker_radius(spark, sf_dir):
    c = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return c.select("c_nationkey", F.round(geo.marker_radius(F.col("n")), 6).alias("radius"))


# changes


@query(
    "SELECT o.o_orderkey, CASE WHEN lower(trim(o.s)) NOT IN ('', 'unknown') THEN o.s WHEN n.s <> 'unknown' THEN n.s ELSE o.s END AS s FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Unknown' ELSE o_orderstatus END AS s FROM orders) o "
    "LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE o_orderpriority END AS s FROM orders WHERE o_orderkey % 5 <> 0) n USING (o_orderkey)"
)
def fill_only_unknown(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    old = o.selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Unknown' ELSE o_orderstatus END AS s")
    new = o.where("o_orderkey % 5 <> 0").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE o_orderpriority END AS s")
    return M.fill_unknown(old, new, "o_orderkey")


@query(
    "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE ' ' END), ''), CASE WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') END, '2024-01-31') AS d FROM orders"
)
def backfill_dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, d).otherwise(" ").alias("d"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://example.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/story"))).alias("url"))
    return M.backfill(o, "d", dates.from_url(F.col("url")).cast("date").cast("string"), F.lit("2024-01-31")).select("o_orderkey", "d")


@query(
    "WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'unknown' ELSE 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0) "
    "SELECT n.o_orderkey, concat_ws(';', CASE WHEN n.o_orderstatus <> 'unknown' AND n.o_orderstatus <> o.o_orderstatus THEN 'o_orderstatus=' || o.o_orderstatus || '>' || n.o_orderstatus END, 'o_totalprice=up') AS log FROM old o JOIN new n USING (o_orderkey)"
)
def merge_change_log(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey", "if(o_custkey % 2 = 0, 'unknown', 'X') AS o_orderstatus", "o_totalprice + 1 AS o_totalprice")
    merged = M.overwrite(o.where("o_orderkey % 3 <> 0").drop("o_custkey"), new, "o_orderkey", largest=["o_totalprice"]).where("change = 'updated'")
    entry = lambda x: F.when(x["field"] == "o_totalprice", F.concat(x["field"], F.when(x["new_value"].cast("double") > x["previous_value"].cast("double"), "=up"))).otherwise(F.concat(x["field"], F.lit("="), x["previous_value"], F.lit(">"), x["new_value"]))
    return merged.select("o_orderkey", F.array_join(F.transform("changes", entry), ";").alias("log"))


# scalars


@query("SELECT doc_id, length(left(text, list_max(list_filter(range(0, 65), lambda i: strlen(left(text, i)) <= 64)))) AS n, md5(left(text, list_max(list_filter(range(0, 65), lambda i: strlen(left(text, i)) <= 64)))) AS x FROM documents")
def byte_snippet(spark, sf_dir):
    cut = text.byte_snippet(F.col("text"), 64)
    return t(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("n"), F.md5(cut).alias("x"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) || ' ' || lower(c_name) END AS x FROM customer")
def first_last_name(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat_ws("  ", F.lit(""), "c_mktsegment", F.lit("Maria"), "c_name")).otherwise(F.concat_ws(" ", "c_mktsegment", "c_name"))
    return t(spark, sf_dir, "customer").select("c_custkey", text.first_last_name(name).alias("x"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || ',' || user_id WHEN 1 THEN event_type WHEN 2 THEN '' ELSE user_id || ',' || event_type END AS x FROM events")
def json_tolerant_list(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN to_json(array(' ' || event_type, '', cast(user_id AS string))) WHEN 1 THEN event_type || ' ,, ' WHEN 3 THEN user_id || ', ' || event_type END")
    return t(spark, sf_dir, "events").select("event_id", F.array_join(structured.string_list(raw), ",").alias("x"))


@query("SELECT event_id, CAST(user_id + event_id AS DOUBLE) + 0.5 AS total FROM events")
def map_value_sum(spark, sf_dir):
    raw = F.expr("concat('{\"a\": ', user_id, ', \"b\": ', event_id, '.5, \"c\": \"many\", \"d\": null}')")
    return t(spark, sf_dir, "events").select("event_id", structured.map_total(raw).alias("total"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '(?is)\b(?:more from|read more|recommended for you|related articles|related stories|trending now)\b.*$', ''), '\s+', ' ', 'g'))) AS x FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' Read more here' ELSE text END AS text FROM documents)")
def strip_related(spark, sf_dir):
    d = t(spark, sf_dir, "documents").selectExpr("doc_id", "if(doc_id % 2 = 0, text || ' Read more here', text) AS text")
    return d.select("doc_id", F.md5(text.squeeze(structured.before_related(F.col("text")))).alias("x"))


@query("SELECT c_custkey, CASE WHEN s IN ('TX', 'OH', 'WV') THEN 'red' WHEN s IN ('CA', 'DC', 'WI') THEN 'blue' END AS x FROM (SELECT c_custkey, ['TX', 'CA', 'ZZ', 'OH', 'DC', 'WV', 'WI', ''][c_custkey % 8 + 1] AS s FROM customer)")
def state_lean(spark, sf_dir):
    state = F.element_at(F.array(*[F.lit(x) for x in ("tx ", "CA", "ZZ", "oh", "DC", " wv", "WI", "")]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return t(spark, sf_dir, "customer").select("c_custkey", C.lean(state).alias("x"))


@query("SELECT p_partkey, list_sort(list_filter(['brand', 'cold', 'economy', 'small', 'widget'], lambda w: contains(lower(p_name || ' ' || p_type), w)))::VARCHAR AS x FROM part")
def lexicon_union(spark, sf_dir):
    c = F.concat_ws(" ", "p_name", "p_type")
    both = M.union_sorted(text.word_hits(c, ["Widget", "small"]), text.word_hits(c, ["economy", "brand", "widget", "cold"]))
    return t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(both, ", "), F.lit("]")).alias("x"))


# sources held in text


@query(f"SELECT page_id, CAST(n AS INTEGER) AS position, 'Title ' || page_id || '-' || n AS title, url || '/' || n AS link, CASE WHEN n = 1 THEN 'Mon, 01 Jan 2024' END AS published, {_HOST} AS summary FROM pages, (SELECT unnest([0, 1]) AS n)")
def rss_items(spark, sf_dir):
    from ..functions import urls

    p = t(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    item = lambda n, more: F.concat(F.lit("<item>\n<title><![CDATA[Title "), "page_id", F.lit(f"-{n}]]></title><link>"), "url", F.lit(f"/{n}</link>{more}<description>&lt;b&gt;"), "host", F.lit("&lt;/b&gt;</description></item>"))
    xml = F.concat(F.lit("<rss><channel><title>all</title>"), item(0, ""), item(1, "<pubDate>Mon, 01 Jan 2024</pubDate>"), F.lit("</channel></rss>"))
    out = feeds.rss_items(p.select("page_id", xml.alias("xml")), "xml")
    return out.withColumns({"published": F.nullif("published", F.lit("")), "summary": F.regexp_replace("summary", "</?b>", "")}).select("page_id", "position", "title", "link", "published", "summary")


@query(f"SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN '2024-01-02T00:00:00Z' ELSE '20240103T000000Z' END AS published, {_HOST} AS domain FROM pages WHERE page_id % 5 <> 0")
def json_articles(spark, sf_dir):
    from ..functions import urls

    p = t(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    article = F.to_json(F.struct(F.array(F.struct("url", F.when(F.col("page_id") % 2 == 0, "2024-01-02T00:00:00Z").alias("publishedAt"), F.when(F.col("page_id") % 2 == 1, "20240103T000000Z").alias("seendate"), F.col("host").alias("domain"))).alias("articles")))
    answer = F.when(F.col("page_id") % 5 == 0, "not json").otherwise(article)
    return feeds.json_articles(p.select("page_id", answer.alias("body")), "body").select("page_id", "url", "published", "domain")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id FROM events WHERE user_id % 10 <> 3")
def json_lines_roundtrip(spark, sf_dir):
    """Lines of JSON as a scan reads them, one in ten cut short."""
    line = F.to_json(F.struct("event_id", show("ts").alias("ts"), "user_id"))
    lines = t(spark, sf_dir, "events").select(F.when(F.col("user_id") % 10 == 3, F.substring(line, 1, 12)).otherwise(line).alias("line"))
    row = lines.select(F.from_json("line", "event_id long, ts string, user_id long, bad string", {"columnNameOfCorruptRecord": "bad"}).alias("r")).where("r.bad IS NULL")
    return row.select("r.event_id", "r.ts", "r.user_id")
