"""One query an operator, over the test tables, each with the SQL that it must equal.

Columns of the test tables stand in for those of the domain; every moment is fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, geo, ids, structured, text, urls
from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import joins as J
from ..operators import merge as M
from ..operators import select as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-31 00:00:00"
STRONG, WEAK = ["the", "der"], ["and", "und", "que", "les"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moment(s: str = AS_OF) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def show(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# filters, limits


def _slice(days: int | None) -> None:
    where = f"WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY" if days else ""
    name = f"slice_window_{days}d" if days else "slice_window_all"

    def run(spark, sf_dir):
        e = t(spark, sf_dir, "events")
        return S.slices(e, "ts", moment(), {"w": days})["w"].select("event_id", "user_id", "event_type", show("ts").alias("ts"))

    run.__name__ = name
    query(f"SELECT event_id, user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events {where}")(run)


for _days in (3, 7, 30, 90, None):
    _slice(_days)


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND value BETWEEN 10 AND 60 AND user_id BETWEEN 0 AND 1000000 ORDER BY events.ts DESC, event_id LIMIT 2000")
def rest_top_rows(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return S.rest_rows(e, "ts", "event_id", moment(), 168, "0,10,1000000,60", "value", "user_id").select("event_id", show("ts").alias("ts"), "value")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_nationkey BETWEEN 3 AND 12")
def bbox_filter(spark, sf_dir):
    return t(spark, sf_dir, "customer").where(geo.in_bbox(F.col("c_acctbal"), F.col("c_nationkey"), geo.parse_bbox("3,0,12,5000"))).select("c_custkey", "c_acctbal")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click','view') AND value >= 20 AND contains(lower(concat_ws(' ', event_type, props)), '1') AND user_id % 2 = 0")
def faceted_filter(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumns({"even": F.col("user_id") % 2 == 0, "types": F.array("event_type")})
    return S.faceted(e, {"even": True, "user_id": None}, {"types": ["click", "view"]}, (["event_type", "props"], "1"), {"value": (20, None)}).select("event_id", "event_type")


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 8192 AND NOT contains(lower(text), 'license')")
def long_text_filter(spark, sf_dir):
    return S.long_texts(t(spark, sf_dir, "documents"), "text", markers=["license"]).select("doc_id", "n_chars")


@query("SELECT doc_id, length(text) AS size FROM documents ORDER BY length(text) DESC, doc_id LIMIT 25")
def top_long_texts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size")).orderBy(F.desc("size"), "doc_id").limit(25)


@query("SELECT event_id, event_type FROM events WHERE lower(trim(event_type)) NOT IN ('error', 'signup')")
def delete_bare_verbs(spark, sf_dir):
    return S.without_values(t(spark, sf_dir, "events"), "event_type", ["error", "signup"]).select("event_id", "event_type")


@query("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '#00000001') OR contains(CAST(s_suppkey AS VARCHAR), '42')")
def record_search(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    named = S.record_contains(s.select("s_suppkey", F.col("s_name").alias("x")), "#00000001").select("s_suppkey")
    return named.union(S.record_contains(s.select("s_suppkey", F.col("s_suppkey").alias("y")), "42").select("s_suppkey")).distinct()


@query(
    "SELECT field, rows, unknown, round(unknown / rows, 6) AS rate, CASE WHEN unknown / rows > 0.35 THEN 'fail' WHEN unknown / rows > 0.2 THEN 'warn' ELSE 'ok' END AS verdict FROM ("
    "SELECT 'quality' AS field, count(*) AS rows, count(*) FILTER (quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id) UNION ALL "
    "SELECT 'lang', count(*), count(*) FILTER (lang IS NULL OR lower(trim(lang)) IN ('', 'unknown')) FROM documents LEFT JOIN labels USING (doc_id))"
)
def quality_gate(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return S.quality_gate(d, ["quality", "lang"])


@query("SELECT c_custkey, c_acctbal BETWEEN 18 AND 72 AND c_nationkey BETWEEN -179 AND 20 AS inside FROM customer")
def bounds_check(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", geo.in_bbox(F.col("c_acctbal"), F.col("c_nationkey"), (-179, 18, 20, 72)).alias("inside"))


# aggregates


@query("SELECT CAST(floor(value * 10) AS BIGINT) AS cell, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1 ORDER BY n DESC, cell LIMIT 50")
def grid_group(spark, sf_dir):
    g = A.grid(t(spark, sf_dir, "events"), F.floor(F.col("value") * 10).cast("long"), "ts").orderBy(F.desc("n"), "cell").limit(50)
    return g.select("cell", "n", show("first").alias("first"), show("last").alias("last"))


@query("SELECT 'source' AS facet, source AS value FROM documents WHERE source <> '' GROUP BY source UNION ALL SELECT 'lang', lang FROM documents WHERE lang <> '' GROUP BY lang")
def facet_values(spark, sf_dir):
    return A.facet_values(t(spark, sf_dir, "documents"), ["source", "lang"])


@query(
    "SELECT o_orderkey AS story, arg_min(l_returnflag, o) AS l_returnflag, arg_min(l_linestatus, o) AS l_linestatus, strftime(max(l_shipdate), '%Y-%m-%d') AS newest, count(*) AS items "
    "FROM (SELECT *, (l_linenumber, l_partkey, l_returnflag, l_linestatus) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY o_orderkey"
)
def story_group(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus").alias("place"))
    joined = o.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    s = A.stories(joined, F.col("o_orderkey"), "place", ["l_returnflag", "l_linestatus"], "l_shipdate")
    return s.select("story", "l_returnflag", "l_linestatus", F.date_format("newest", "yyyy-MM-dd").alias("newest"), "items")


@query(
    "WITH f AS (SELECT user_id, min(ts) AS ts, bool_or(event_type = 'error') AS err, bool_or(event_type = 'purchase') AS buy FROM events GROUP BY user_id), "
    "w AS (SELECT date_trunc('week', ts) AS week, count(*) AS total, count(*) FILTER (err) AS n_err, count(*) FILTER (buy) AS n_buy FROM f GROUP BY 1) "
    "SELECT strftime(week, '%Y-%m-%d') AS week, total, n_err, CASE WHEN total >= 5 THEN round(n_err / total, 6) ELSE 0.0 END AS rate_err, n_buy, CASE WHEN total >= 5 THEN round(n_buy / total, 6) ELSE 0.0 END AS rate_buy FROM w"
)
def article_flags_weekly(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    folded = A.fold_flags(e, "user_id", {"err": F.col("event_type") == "error", "buy": F.col("event_type") == "purchase"}, "ts")
    return A.weekly(folded, "ts", ["err", "buy"]).withColumn("week", F.col("week").cast("string"))


@query(
    "WITH c AS (SELECT n_name, date_trunc('week', o_orderdate) AS week, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2), "
    "top AS (SELECT n_name FROM c GROUP BY 1 ORDER BY sum(n) DESC, n_name LIMIT 5) SELECT n_name, strftime(week, '%Y-%m-%d') AS week, n FROM c WHERE n_name IN (FROM top)"
)
def top_states_weekly(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderdate").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.top_groups_weekly(o, "n_name", "o_orderdate", 5).select("n_name", F.col("week").cast("string").alias("week"), "n")


@query("SELECT 'year' AS facet, CAST(year(o_orderdate) AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'status', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2")
def index_counts(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return A.index_counts(o, ["year", "status", "priority"])


@query("SELECT strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders")
def index_date_range(spark, sf_dir):
    return A.date_range(t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "d")


@query(r"SELECT lower(trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'))) AS k, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def having_duplicates(spark, sf_dir):
    return A.duplicated(t(spark, sf_dir, "documents"), [text.norm_title(F.col("text")).alias("k")], "doc_id")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"


@query(f"SELECT host, count(*) AS n FROM (SELECT {_HOST} AS host FROM pages) GROUP BY 1 HAVING count(*) >= 2")
def host_counts(spark, sf_dir):
    return A.host_counts(t(spark, sf_dir, "pages"), urls.host(F.col("url")), 2)


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT source, arg_min(lang, (-n, lang)) AS lang FROM c GROUP BY 1")
def mode_per_group(spark, sf_dir):
    return A.mode_by(t(spark, sf_dir, "documents"), "source", "lang")


@query(f"SELECT DISTINCT host FROM (SELECT {_HOST} AS host FROM pages) WHERE host NOT IN (SELECT {_HOST} FROM pages WHERE page_id % 2 = 0)")
def missing_hosts_anti(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return p.select("host").distinct().join(p.where("page_id % 2 = 0").select("host"), "host", "left_anti")


@query("SELECT 'type:' || event_type AS flag, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'high', count(*) FROM events WHERE value > 50")
def flag_counts(spark, sf_dir):
    flags = F.array_compact(F.array(F.concat(F.lit("type:"), "event_type"), F.when(F.col("value") > 50, "high")))
    return A.flag_counts(t(spark, sf_dir, "events"), flags)


@query("SELECT strftime(w.week, '%Y-%m-%d') AS week, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-12', INTERVAL 7 DAY)) AS week) w LEFT JOIN (SELECT date_trunc('week', ts) AS week, count(*) AS n FROM events GROUP BY 1) e ON e.week = w.week")
def week_spine(spark, sf_dir):
    weeks = t(spark, sf_dir, "events").groupBy(dates.week_start(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    return A.all_weeks(weeks, "week", "2023-12-25", "2024-02-12").withColumn("week", F.col("week").cast("string"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '(?:^|[^\\p{L}\\p{N}])the(?:[^\\p{L}\\p{N}]|$)')) AS n FROM documents")
def mention_counts(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.regexp_count(F.lower("text"), F.lit(r"(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|$)")).cast("long").alias("n"))


# joins


@query(
    "SELECT coalesce(a.m, b.m) AS m, coalesce(a.n, b.n) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1) a "
    "FULL JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS m, -count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1) b USING (m)"
)
def monthly_merge_prefer(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderdate")
    a = o.where(F.col("o_orderdate") < moment("1998-07-01 00:00:00")).groupBy("m").agg(F.count("*").alias("n"))
    b = o.where(F.col("o_orderdate") >= moment("1998-01-01 00:00:00")).groupBy("m").agg((-F.count("*")).alias("n"))
    return J.prefer_left(a, b, ["m"])


@query(
    "SELECT o_orderkey, label FROM orders ASOF LEFT JOIN (SELECT * FROM (VALUES (DATE '1996-01-20', 'first'), (DATE '1997-06-01', 'second'), (DATE '2000-01-01', 'third')) v(start, label)) ON CAST(o_orderdate AS DATE) >= start"
)
def asof_label(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    bounds = [("1996-01-20", "first"), ("1997-06-01", "second"), ("2000-01-01", "third")]
    return o.select("o_orderkey", J.as_of(o, "o_orderdate", bounds).alias("label"))


@query(
    "WITH c AS (SELECT n_nationkey AS pos, lower(n_name) AS name, lower(substr(n_name, 1, 3)) AS short FROM nation) SELECT p_partkey, arg_min(name, pos) AS name FROM part "
    "LEFT JOIN c ON contains(lower(p_name || ' ' || p_type), name) OR contains(lower(p_name || ' ' || p_type), short) GROUP BY p_partkey"
)
def theta_catalog_first(spark, sf_dir):
    catalog = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("name"), F.lower(F.substring("n_name", 1, 3)).alias("short"))
    p = t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("q"))
    return J.first_contained(p, "q", ["p_partkey"], catalog, ["name", "short"], "pos").select("p_partkey", "name")


@query(
    f"WITH c AS (SELECT user_id AS q, max(ts) AS fetched_at, CASE WHEN user_id % 3 = 0 THEN 1.0 END AS lat FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT DISTINCT user_id, "
    f"CASE WHEN lat IS NOT NULL THEN 'hit' WHEN fetched_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'fresh_failure' ELSE 'needs_lookup' END AS status FROM events LEFT JOIN c ON q = user_id"
)
def cache_join_status(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "ts")
    cache = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("q")).agg(F.max("ts").alias("fetched_at")).withColumn("lat", F.when(F.col("q") % 3 == 0, 1.0))
    asked = e.select("user_id").distinct().join(cache, F.col("user_id") == F.col("q"), "left")
    return asked.select("user_id", geo.cache_status(F.col("lat"), F.col("fetched_at"), moment()).alias("status"))


@query(f"SELECT page_id FROM pages WHERE {_HOST} = 'example.com' OR suffix({_HOST}, '.example.com') OR suffix({_HOST}, '.org')")
def semi_allowed(spark, sf_dir):
    return t(spark, sf_dir, "pages").where(urls.in_domains(F.col("url"), ["example.com", "org"])).select("page_id")


@query(f"SELECT page_id FROM pages WHERE NOT (starts_with(regexp_extract(url, '^[a-zA-Z]+://[^/]+(/[^?#]*)', 1), '/p1') AND {_HOST} IN (SELECT {_HOST} FROM pages WHERE page_id < 20))")
def anti_blocked(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("path"))
    blocked = p.where("page_id < 20").select(F.col("h").alias("host"), F.lit("/p1").alias("prefix")).distinct()
    return J.not_blocked(p, "h", "path", blocked).select("page_id")


_TITLE = r"lower(trim(regexp_replace(left(text, 40), '[^\p{L}\p{N}_]+', ' ', 'g')))"


@query(f"WITH d AS (SELECT doc_id, {_TITLE} AS k FROM documents) SELECT min(doc_id) AS doc_id FROM d WHERE doc_id >= 100 AND k <> '' AND k NOT IN (SELECT k FROM d WHERE doc_id < 100) GROUP BY k UNION ALL SELECT doc_id FROM d WHERE doc_id >= 100 AND k = ''")
def anti_seen_titles(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.left("text", F.lit(40))).alias("k"))
    return J.unseen(d.where("doc_id >= 100"), d.where("doc_id < 100"), "k", "doc_id").select("doc_id")


@query("SELECT source, arg_max(doc_id, (length(text), -doc_id)) AS doc_id, max(length(text)) AS size FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'de') GROUP BY source")
def longest_text_per_key(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    best = J.longest_text(d, d.where("lang = 'de'"), "source", "text", "doc_id")
    ids_ = d.withColumn("__k", F.md5("text")).join(best.select("source", F.md5("text").alias("__k"), F.length("text").alias("size")), ["source", "__k"])
    return ids_.groupBy("source").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))


@query(
    "WITH a AS (SELECT s_nationkey AS n, CAST(floor(s_acctbal / 1000) AS BIGINT) AS band, min_by(s_name, s_suppkey) AS v FROM supplier GROUP BY 1, 2), b AS (SELECT s_nationkey AS n, min_by(s_name, s_suppkey) AS v FROM supplier GROUP BY 1) "
    "SELECT c_custkey, coalesce(a.v, b.v) AS s_name FROM customer LEFT JOIN a ON a.n = c_nationkey AND a.band = CAST(floor(c_acctbal / 1000) AS BIGINT) LEFT JOIN b ON b.n = c_nationkey"
)
def two_level_fallback_join(spark, sf_dir):
    band = lambda c: F.floor(F.col(c) / 1000).cast("long")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"), band("c_acctbal").alias("band"))
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nationkey"), band("s_acctbal").alias("band"))
    return J.fallback(c, s, [["nationkey", "band"], ["nationkey"]], "s_name", "s_suppkey").select("c_custkey", "s_name")


@query(
    "SELECT a.o_custkey, a.o_orderkey AS first_id, b.o_orderkey AS second_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)) BETWEEN 0 AND 14 "
    "AND (CAST(a.o_orderdate AS DATE), a.o_orderkey) < (CAST(b.o_orderdate AS DATE), b.o_orderkey)"
)
def interval_self_join(spark, sf_dir):
    return J.near_in_time(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey", 14).select("o_custkey", "first_id", "second_id")


@query(
    "WITH h AS (SELECT c_custkey, s_suppkey, CASE WHEN c_custkey = s_suppkey AND c_nationkey = s_nationkey THEN 1 WHEN c_nationkey = s_nationkey AND floor(c_acctbal / 100) = floor(s_acctbal / 100) THEN 2 ELSE 3 END AS r FROM customer JOIN supplier "
    "ON c_nationkey = s_nationkey AND (c_custkey = s_suppkey OR floor(c_acctbal / 100) = floor(s_acctbal / 100) OR c_custkey % 500 = s_suppkey)) SELECT c_custkey, arg_min(s_suppkey, (r, s_suppkey)) AS s_suppkey, min(r) AS rule FROM h GROUP BY 1"
)
def ranked_identity_match(spark, sf_dir):
    c, s, same = t(spark, sf_dir, "customer"), t(spark, sf_dir, "supplier"), (F.col("c_nationkey"), F.col("s_nationkey"))
    rules = [[same, (F.col("c_custkey"), F.col("s_suppkey"))], [same, (F.floor(F.col("c_acctbal") / 100), F.floor(F.col("s_acctbal") / 100))], [same, (F.col("c_custkey") % 500, F.col("s_suppkey"))]]
    return J.ranked(c, s, rules, "c_custkey", "s_suppkey")


# windows


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def first_per_key(spark, sf_dir):
    return A.first_per_key(t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) AS rank FROM lineitem) WHERE rank <= 2")
def top2_per_group(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return A.top_per_group(li, ["l_orderkey"], 2, F.desc("l_extendedprice"), "l_linenumber", "l_partkey").drop("l_partkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, min(l_returnflag) OVER w = max(l_returnflag) OVER w AS single FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def group_condition(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", A.only_value(li, ["l_orderkey"], "l_returnflag").alias("single"))


@query("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS bought FROM events")
def sibling_flag(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", A.has_sibling(["user_id"], F.col("event_type") == "purchase").alias("bought"))


@query("SELECT event_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM (SELECT *, CASE WHEN CAST(ts AS DATE) = CAST(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE) THEN 0 ELSE 1 END AS s FROM events)")
def lag_change(spark, sf_dir):
    return A.day_runs(t(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("event_id", F.col("run").cast("long").alias("run"))


@query("SELECT event_id, event_id = min(event_id) OVER (PARTITION BY props) AS first_seen FROM events")
def first_seen(spark, sf_dir):
    from pyspark.sql import Window

    return t(spark, sf_dir, "events").select("event_id", (F.col("event_id") == F.min("event_id").over(Window.partitionBy("props"))).alias("first_seen"))


# DML


def _halves(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 2 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "o_orderstatus": F.when(F.col("o_custkey") % 2 == 0, "unknown").otherwise(F.lit("X"))})
    return old, new


_OLD = "old AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "new AS (SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 2 = 0 THEN 'unknown' ELSE 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def upsert_latest(spark, sf_dir):
    return M.upsert(*_halves(spark, sf_dir), ["o_orderkey"], "o_totalprice").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def insert_ignore(spark, sf_dir):
    return M.insert_ignore(*_halves(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_custkey NOT IN (SELECT o_custkey FROM new)")
def delete_insert(spark, sf_dir):
    return M.delete_insert(*_halves(spark, sf_dir), "o_custkey")


@query(
    f"WITH {_OLD}, {_NEW} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(nullif(trim(a.o_orderstatus), 'F'), b.o_orderstatus) AS o_orderstatus, "
    "coalesce(a.o_totalprice, b.o_totalprice) AS o_totalprice FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey"
)
def fill_only_merge(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return M.fill_only(old.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus"))), new, "o_orderkey")


@query(
    f"WITH {_OLD}, {_NEW}, m AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_orderstatus AS s0, CASE WHEN b.o_orderstatus IS NOT NULL AND (b.o_orderstatus <> 'unknown' OR a.o_orderstatus IS NULL) THEN b.o_orderstatus ELSE a.o_orderstatus END AS o_orderstatus, "
    "a.o_totalprice AS p0, CASE WHEN b.o_totalprice IS NULL THEN a.o_totalprice WHEN a.o_totalprice IS NULL THEN b.o_totalprice ELSE greatest(a.o_totalprice, b.o_totalprice) END AS o_totalprice FROM old a FULL JOIN new b ON a.o_orderkey = b.o_orderkey) "
    "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN ak IS NULL THEN 'added' WHEN bk IS NOT NULL AND (s0 IS DISTINCT FROM o_orderstatus OR p0 IS DISTINCT FROM o_totalprice) THEN 'updated' ELSE 'same' END AS change FROM m"
)
def placeholder_merge_diff(spark, sf_dir):
    old, new = (x.drop("o_custkey") for x in _halves(spark, sf_dir))
    return M.overwrite(old, new, "o_orderkey", largest=["o_totalprice"]).drop("changes")


@query("SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE o_orderstatus END), ''), o_orderpriority) AS s FROM orders")
def backfill_coalesce(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 4 == 0, " ").otherwise(F.col("o_orderstatus")).alias("s"), "o_orderpriority")
    return M.backfill(o, "s", F.col("o_orderpriority")).select("o_orderkey", "s")


@query("SELECT o_custkey, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen FROM orders GROUP BY 1")
def bump_sightings(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_seen")).withColumn("last_seen", F.col("first_seen"))
    return M.bump(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_custkey", "first_seen", "last_seen")


# sets


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_sources(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return M.union_all(c, t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def array_union_sorted(spark, sf_dir):
    low, high = (F.collect_set(F.when(c, F.col("event_type"))) for c in (F.col("value") < 30, F.coalesce(F.col("value") >= 30, F.lit(True))))
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(low.alias("a"), high.alias("b"))
    return e.select("user_id", F.array_join(M.union_sorted(F.col("a"), F.col("b")), ",").alias("types"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type IN ('error', 'signup'))")
def overlap_filter(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return S.faceted(e, any_of={"types": ["error", "signup"]}).select("user_id")


@query("SELECT user_id, bool_or(event_type = 'click') AND bool_or(event_type = 'purchase') AS both FROM events GROUP BY 1")
def subset_flag(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("types"))
    return e.select("user_id", M.has_all(F.col("types"), ["click", "purchase"]).alias("both"))


# scalars


def _docs(name: str, expr: Callable[[Column], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return t(spark, sf_dir, "documents").select("doc_id", expr(F.col("text")).alias("x"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS x FROM documents")(run)


_docs("norm_title", lambda c: text.norm_title(F.left(c, F.lit(200))), r"lower(trim(regexp_replace(left(text, 200), '[^\p{L}\p{N}_]+', ' ', 'g')))")
_docs("clean_ws", lambda c: F.md5(text.squeeze(c)), r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))")
_docs("slug", lambda c: text.slug(F.left(c, F.lit(80))), "regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
_docs("word_trim", lambda c: text.trim_words(c, 6), r"CASE WHEN len(string_split_regex(trim(text), '\s+')) > 6 THEN array_to_string(string_split_regex(trim(text), '\s+')[1:6], ' ') ELSE text END")
_docs("sentence_top5", lambda c: text.first_sentences(c, 5), r"array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)[1:5], ' ')")
_docs("snippet", lambda c: text.snippet(c, F.greatest(F.instr(c, "the"), F.lit(1)), 40), "substr(text, greatest(1, greatest(instr(text, 'the'), 1) - 40), greatest(instr(text, 'the'), 1) + 40 - greatest(1, greatest(instr(text, 'the'), 1) - 40))")
_docs("ascii_safe", lambda c: text.ascii_only(F.left(c, F.lit(60))), r"regexp_replace(left(text, 60), '[^\x00-\x7F]', '?', 'g')")
_docs("match_text", lambda c: text.match_text(F.left(c, F.lit(120))), "trim(regexp_replace(lower(left(text, 120)), '[^a-z0-9]+', ' ', 'g'))")
_docs("keyword_relevance", lambda c: C.relevant(c, ["the", "und", "que"], ["The"], 2, None), r"(CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'und') AS INT) + CAST(contains(lower(text), 'que') AS INT) + CAST(regexp_matches(text, '(?:^|[^\p{L}\p{N}])The(?:[^\p{L}\p{N}]|$)') AS INT)) >= 2")
_docs("event_types", lambda c: F.array_join(text.labels(c, [("en", r"(?i)(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|$)"), ("de", r"(?i)(?:^|[^\p{L}\p{N}])und(?:[^\p{L}\p{N}]|$)"), ("es", r"(?i)(?:^|[^\p{L}\p{N}])los(?:[^\p{L}\p{N}]|$)")]), ","), r"concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|$)') THEN 'en' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])und(?:[^\p{L}\p{N}]|$)') THEN 'de' END, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])los(?:[^\p{L}\p{N}]|$)') THEN 'es' END)")
_docs("ladder_class", lambda c: text.ladder(c, [("de", r"(?i)(?:^|[^\p{L}\p{N}])und(?:[^\p{L}\p{N}]|$)"), ("en", r"(?i)(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|$)")], "other"), r"CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])und(?:[^\p{L}\p{N}]|$)') THEN 'de' WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}])the(?:[^\p{L}\p{N}]|$)') THEN 'en' ELSE 'other' END")
_docs("additive_score", lambda c: C.score(c, ["the", "of"], ["und"]).cast("long"), "CAST(contains(lower(text), 'the') AS BIGINT) * 3 + CAST(contains(lower(text), 'of') AS BIGINT) * 3 - CAST(contains(lower(text), 'und') AS BIGINT) * 2")


@query(
    r"WITH w AS (SELECT doc_id, text, left(text, 40) AS title, string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS b, string_split(regexp_replace(lower(left(text, 1200)), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS h, string_split(regexp_replace(lower(left(text, 40)), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS ti FROM documents) "
    "SELECT doc_id, list_has_any(ti, ['the','der','and','und','que','les']) OR list_has_any(h, ['the','der']) OR len(list_intersect(['and','und','que','les'], b)) >= 2 AS x FROM w"
)
def topic_gate(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", C.on_topic(F.left("text", F.lit(40)), F.col("text"), STRONG, WEAK).alias("x"))


def _customers(name: str, expr: Callable[[], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return t(spark, sf_dir, "customer").select("c_custkey", expr().alias("x"))

    run.__name__ = name
    query(f"SELECT c_custkey, {sql} AS x FROM customer")(run)


_customers("initcap_name", lambda: text.display_name(F.concat(F.lower("c_mktsegment"), F.lit(", JOHN"))), "'John ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))")
_customers("canonical_name", lambda: text.canonical_name(F.concat(F.lit("José-"), "c_mktsegment", F.lit(" O'Neil"))), "'jose ' || lower(c_mktsegment) || ' o neil'")
_NS = "unhex('31f4a5a32f5f4e6f98b81e857de534d6')"
_customers(
    "uuid5_id",
    lambda: ids.uuid5(F.lower("c_name")),
    f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] FROM (SELECT sha1({_NS} || encode(lower(c_name))) AS h))",
)
_customers("enum_guard", lambda: C.enum(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "unknown"), "CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE 'unknown' END")
_customers("tri_bool", lambda: C.tri_bool(F.element_at(F.array(F.lit("yes"), F.lit("No "), F.lit("maybe")), (F.col("c_custkey") % 3 + 1).cast("int"))), "CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END")
_customers("clamp", lambda: C.clamp(F.floor("c_acctbal").cast("int")), "CAST(greatest(0, least(100, floor(c_acctbal))) AS INTEGER)")
_customers("near_point", lambda: geo.near(F.col("c_acctbal"), F.col("c_nationkey"), (1000.0, 10.0), 500.0), "abs(c_acctbal - 1000) <= 500 AND abs(c_nationkey - 10) <= 500")


def _orders(name: str, expr: Callable[[], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return t(spark, sf_dir, "orders").select("o_orderkey", expr().alias("x"))

    run.__name__ = name
    query(f"SELECT o_orderkey, {sql} AS x FROM orders")(run)


def _cut() -> Column:
    return F.substring(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(1), F.element_at(F.array(F.lit(4), F.lit(7), F.lit(10)), (F.col("o_orderkey") % 3 + 1).cast("int")))


_orders("partial_date", lambda: dates.partial(_cut()).cast("string"), "strftime(date_trunc(CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END, o_orderdate), '%Y-%m-%d')")
_orders("date_precision", lambda: dates.precision(_cut()), "CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END")
_orders("fiscal_month", lambda: dates.fiscal_month(F.year("o_orderdate"), F.month("o_orderdate")).cast("string"), "strftime(make_date(CASE WHEN month(o_orderdate) >= 10 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END, month(o_orderdate), 1), '%Y-%m-%d')")
_orders("week_start", lambda: dates.week_start(F.col("o_orderdate")).cast("string"), "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d')")
_orders("end_of_day", lambda: F.date_format(dates.day_end(F.col("o_orderdate")), "yyyy-MM-dd HH:mm:ss.SSS"), "strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59.999'")
_orders("grid_key", lambda: geo.cell(F.floor("o_totalprice"), F.col("o_custkey")), "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.000,' || CAST(o_custkey AS VARCHAR) || '.000'")
_orders("recency_band", lambda: C.recency(F.col("o_orderdate").cast("timestamp"), F.lit("1998-01-01 00:00:00").cast("timestamp")), "(SELECT CASE WHEN h <= 6 THEN '6h' WHEN h <= 24 THEN '24h' WHEN h <= 72 THEN '72h' WHEN h <= 168 THEN 'week' ELSE 'older' END FROM (SELECT date_diff('second', o_orderdate, TIMESTAMP '1998-01-01') / 3600 AS h))")


def _pages(name: str, expr: Callable[[], Column], sql: str) -> None:
    def run(spark, sf_dir):
        return t(spark, sf_dir, "pages").select("page_id", expr().alias("x"))

    run.__name__ = name
    query(f"SELECT page_id, {sql} AS x FROM pages")(run)


_pages("host_extract", lambda: urls.host(F.col("url")), _HOST)
_pages("suffix_match", lambda: urls.matches_domain(urls.host(F.col("url")), "com"), f"suffix({_HOST}, '.com')")
_pages("page_param", lambda: urls.set_page(F.col("url"), 3), r"CASE WHEN regexp_matches(url, '[?&]page=\d*') THEN regexp_replace(url, '([?&])page=\d*', '\1page=3', 'g') WHEN contains(url, '?') THEN url || '&page=3' ELSE url || '?page=3' END")
_STRIP = r"regexp_replace(regexp_replace({0}, '(?is)<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
_UNESC = "replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&')"
_TEXT = r"md5(trim(regexp_replace(" + _UNESC.format(_STRIP) + r", '\s+', ' ', 'g')))"
_pages("html_text", lambda: F.md5(structured.html_text(F.col("html"))), _TEXT.format("html"))
_pages("main_content", lambda: F.md5(structured.main_content(F.col("html"))), _TEXT.format(r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1)"))
_pages("link_extract", lambda: F.size(structured.links(F.col("html"))).cast("long"), "CAST(len(list_distinct(regexp_extract_all(html, '(?is)<a\\b[^>]*href\\s*=.*?</a>'))) AS BIGINT)")


# no SQL: rows and unit tests


@query()
def cluster_collapse(spark, sf_dir):
    """Greedy duplicates among records made of documents."""
    from ..operators import incidents

    d = t(spark, sf_dir, "documents")
    rec = d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Jane "), F.initcap("source"), F.lit(" Person")).alias("person_name"), F.lit("2025-01-02").alias("date_of_death"),
        F.col("lang").alias("facility_or_location"), F.lit("detention").alias("death_context"),
    )
    rec = rec.withColumn("person_name", F.translate("person_name", "0123456789", "abcdefghij"))
    return incidents.collapse(incidents.normalize(rec, "2026-01-24")).select("id", "person_name", "date_of_death", "facility_or_location", "confidence_score")


@query()
def extract_rule_based(spark, sf_dir):
    """Who, what and where by rule, at most two a text."""
    from . import extract

    d = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("story_id"), "text")
    return extract.triplets(d, "story_id", "text")


from . import queries_more as _more  # noqa: E402, F401  registers its queries
