"""The registered queries, each with the SQL that a DuckDB oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import predicates as P
from spanloom.functions import udfs, values
from spanloom.operators import grouping, joins, pairing, spans, vectors, windows
from spanloom.operators.relation import Relation, direction, splat, stitch, trim
from spanloom.plans import dialect
from spanloom.session import configure
from spanloom.sources import sinks
from spanloom.sources.tables import captions, containers, epoch, renditions, scan, series, struct_rows, unnest
from spanloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    """Register a function under its name; it gets a table reader beside the session and the folder."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return f(spark, lambda name, *cols: scan(spark, sf_dir, name, *cols), sf_dir)

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def lines(t) -> DataFrame:
    return containers(t("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"), t("lineitem"))


EV = "SELECT *, epoch_us(ts) / 1e6 AS t FROM events"
NESTED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_returnflag, l_shipdate) AS k FROM lineitem"


# --- filters -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND (o_orderstatus = 'F' OR NOT o_orderpriority <= '2') AND o_orderkey <> o_custkey")
def filter_compare(spark, t, d):
    return t("orders").where((C("o_totalprice") > 400000) & ((C("o_orderstatus") == "F") | ~(C("o_orderpriority") <= "2")) & (C("o_orderkey") != C("o_custkey"))).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_extendedprice * (1 - l_discount) BETWEEN 1000 AND 20000")
def filter_between(spark, t, d):
    net = C("l_extendedprice") * (1 - C("l_discount"))
    return t("lineitem").where(C("l_quantity").between(10, 12) & net.between(1000, 20000)).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, seg IS NULL AS missing, (seg <> 'HOUSEHOLD') AS other FROM c WHERE seg IS NULL OR seg <> 'HOUSEHOLD'")
def filter_nulls(spark, t, d):
    c = t("customer").select("c_custkey", F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return c.where(C("seg").isNull() | (C("seg") != "HOUSEHOLD")).select("c_custkey", C("seg").isNull().alias("missing"), (C("seg") != "HOUSEHOLD").alias("other"))


@query("WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, seg FROM c WHERE seg IN ('HOUSEHOLD', 'MACHINERY') OR c_custkey IN (1, 2, 3) AND seg NOT IN ('AUTOMOBILE')")
def filter_in(spark, t, d):
    c = t("customer").select("c_custkey", F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    return c.where(C("seg").isin("HOUSEHOLD", "MACHINERY") | C("c_custkey").isin(1, 2, 3) & ~C("seg").isin("AUTOMOBILE"))


@query("WITH p AS (SELECT p_partkey, p_size > 25 AS large FROM part) SELECT p_partkey FROM p WHERE large")
def filter_bool(spark, t, d):
    return t("part").select("p_partkey", (C("p_size") > 25).alias("large")).where(C("large")).select("p_partkey")


@query("SELECT event_id, ts, round(epoch_us(ts) / 1e6 - epoch_us(TIMESTAMP '2024-01-05 00:00:00') / 1e6, 6) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-07 12:00:00'")
def trim_window(spark, t, d):
    low, high = F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-07 12:00:00").cast("timestamp")
    e = epoch(trim(t("events", "event_id", "ts"), "ts", low, high))
    return e.select("event_id", "ts", F.round(C("t") - F.unix_micros(low) / F.lit(1e6), 6).alias("t"))


@query(f"""WITH e AS ({EV}), c AS (SELECT user_id AS cu, event_id AS cue_id, t AS s, t + value * 60 AS z FROM e WHERE event_type = 'purchase')
SELECT cue_id, event_id, user_id, round(t - s, 3) AS at FROM e JOIN c ON user_id = cu AND t BETWEEN s AND z WHERE event_type = 'view'""")
def row_bounded_window(spark, t, d):
    e = epoch(t("events"))
    cue = e.where("event_type = 'purchase'").select("user_id", C("event_id").alias("cue_id"), C("t").alias("s"), (C("t") + C("value") * 60).alias("z"))
    view = e.where("event_type = 'view'").select("event_id", "user_id", "t")
    return joins.band_join(view, cue, ["user_id"], "t", "s", "z", 1800.0).select("cue_id", "event_id", "user_id", F.round(C("t") - C("s"), 3).alias("at"))


# --- projection ----------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def project_star_except(spark, t, d):
    return Relation.of(t("customer"), "c_custkey").star(leave=("c_acctbal", "not_there")).frame()


@query("SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, round(s_acctbal * 2, 2) AS s_acctbal FROM supplier")
def project_star_replace(spark, t, d):
    return Relation.of(t("supplier"), "s_suppkey").star(replace={"s_name": F.upper("s_name"), "s_acctbal": F.round(C("s_acctbal") * 2, 2)}).frame()


@query(f"WITH k AS ({NESTED}) SELECT o_orderkey, l_partkey AS first_part, l_quantity AS first_quantity, o_orderstatus AS status FROM orders JOIN k ON l_orderkey = o_orderkey WHERE k = 1")
def subscript_path(spark, t, d):
    return lines(t).select("o_orderkey", C("items")[0]["l_partkey"].alias("first_part"), values.item(C("items"), 1)["l_quantity"].alias("first_quantity"), F.try_element_at("tags", F.lit("status")).alias("status"))


@query("SELECT o_orderkey, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS priority, 'yes' AS seen, 2 AS n_tags FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def map_path_merge(spark, t, d):
    tags = values.merge_maps(C("tags"), F.create_map(F.lit("seen"), F.lit("yes"), F.lit("priority"), F.lit(None).cast("string")))
    o = lines(t).withColumn("tags", tags)
    at = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return o.select("o_orderkey", at("status"), at("priority"), at("seen"), F.size("tags").alias("n_tags"))


@query("SELECT n_nationkey, n_name AS title, CAST(n_nationkey AS DOUBLE) AS start_t, n_nationkey + 1.5 AS end_t FROM nation")
def struct_literal(spark, t, d):
    s = F.struct(C("n_name").alias("title"), C("n_nationkey").cast("double").alias("start_t"), (C("n_nationkey") + F.lit(1.5)).alias("end_t"))
    return t("nation").select("n_nationkey", s.alias("c")).select("n_nationkey", "c.*")


@query("""WITH k AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey AS o_orderkey, q[1] AS q_1, q[2] AS q_2, q[3] AS q_3 FROM k""")
def array_splat(spark, t, d):
    q = lines(t).select("o_orderkey", F.transform("items", lambda x: x["l_quantity"]).alias("q"))
    return splat(q, "q", 3)


@query("""WITH k AS (SELECT l_orderkey, sum(l_quantity * l_extendedprice) AS total FROM lineitem GROUP BY 1) SELECT l_orderkey AS o_orderkey, round(total, 2) AS total FROM k""")
def array_zip_variadic(spark, t, d):
    zipped = values.zip_arrays(F.transform("items", lambda x: x["l_quantity"]), F.transform("items", lambda x: x["l_extendedprice"]), lambda a, b: a * b)
    return lines(t).select("o_orderkey", F.round(F.aggregate(zipped, F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# --- values ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size // 7 AS whole, -(p_size - 30) % 7 AS rest, CASE WHEN p_size - 30 < 0 THEN -((30 - p_size) // 4) ELSE (p_size - 30) // 4 END AS toward_zero, round(p_retailprice / 7, 6) AS part, p_size * 3 - 1 AS m FROM part")
def value_arith_intdiv(spark, t, d):
    s = C("p_size")
    return t("part").select("p_partkey", values.divide(s, F.lit(7), True).alias("whole"), (-(s - 30) % 7).alias("rest"), values.divide(s - 30, F.lit(4), True).alias("toward_zero"), F.round(values.divide(C("p_retailprice"), F.lit(7), False), 6).alias("part"), (s * 3 - 1).alias("m"))


@query("SELECT p_partkey, p_brand || '/' || CAST(p_size AS VARCHAR) AS tag, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, replace(p_name, 'r', 'RR') AS r, substring(p_name, 2, 3) AS s, CASE WHEN 1 > 0 THEN substring(p_name, 1, 2) END AS early, substring(p_name, 4) AS rest FROM part")
def value_text(spark, t, d):
    n = C("p_name")
    return t("part").select("p_partkey", values.joined(C("p_brand"), F.lit("/"), C("p_size").cast("string")).alias("tag"), F.upper(n).alias("u"), F.lower("p_type").alias("l"), F.length(n).alias("n"), F.replace(n, F.lit("r"), F.lit("RR")).alias("r"), values.substring(n, 2, 3).alias("s"), values.substring(n, 0, 3).alias("early"), values.substring(n, 4).alias("rest"))


@query("WITH c AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS band, CASE seg WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END AS home, coalesce(seg, c_name) AS label FROM c")
def value_case_coalesce(spark, t, d):
    c = t("customer").withColumn("seg", F.nullif(C("c_mktsegment"), F.lit("BUILDING")))
    band = F.when(C("c_acctbal") < 0, "debt").when(C("c_acctbal") < 5000, "some").otherwise("much")
    return c.select("c_custkey", band.alias("band"), F.when(C("seg") == "HOUSEHOLD", 1).otherwise(0).alias("home"), F.coalesce("seg", "c_name").alias("label"))


@query("SELECT o_orderkey, round(o_totalprice) AS r0, round(o_totalprice * 0.1, 1) AS r1 FROM orders")
def value_round(spark, t, d):
    return t("orders").select("o_orderkey", F.round("o_totalprice").alias("r0"), F.round(C("o_totalprice") * 0.1, 1).alias("r1"))


@query("SELECT n_nationkey, (ARRAY['a', 'b', 'c', 'd', 'e'])[n_regionkey + 1] AS letter, 5 AS n FROM nation")
def array_element(spark, t, d):
    a = F.array(*map(F.lit, "abcde"))
    return t("nation").select("n_nationkey", values.item(a, C("n_regionkey") + 1).alias("letter"), F.size(a).alias("n"))


@query("WITH v(s) AS (VALUES ('4500k'), ('3M'), ('2MB'), ('1Ki'), ('12'), ('x')) SELECT s, CASE s WHEN '4500k' THEN 4500000 WHEN '3M' THEN 3000000 WHEN '2MB' THEN 16000000 WHEN '1Ki' THEN 1024 WHEN '12' THEN 12 END AS bps FROM v")
def value_bits(spark, t, d):
    return spark.createDataFrame([("4500k",), ("3M",), ("2MB",), ("1Ki",), ("12",), ("x",)], "s string").withColumn("bps", values.bits_per_second(C("s")))


# --- rows from arrays, series, written rows ------------------------------------------------------------------------------


@query(f"WITH k AS ({NESTED}) SELECT o_orderkey, k AS index, l_partkey, l_quantity, l_discount FROM orders JOIN k ON l_orderkey = o_orderkey WHERE l_discount >= 0.05")
def unnest_items(spark, t, d):
    rows = unnest(lines(t).select("o_orderkey", "items"), "items", "l")
    return rows.where(C("l.l_discount") >= 0.05).select("o_orderkey", "index", C("l.l_partkey").alias("l_partkey"), C("l.l_quantity").alias("l_quantity"), C("l.l_discount").alias("l_discount"))


@query("WITH v(index, name, low) AS (VALUES (1, 'small', 0), (2, 'mid', 15), (3, 'big', 35)) SELECT p_partkey, max(index) AS rung FROM part JOIN v ON p_size >= low GROUP BY 1")
def struct_rows_join(spark, t, d):
    v = struct_rows(spark, [{"name": "small", "low": 0}, {"name": "mid", "low": 15}, {"name": "big", "low": 35}], "name string, low int")
    return t("part").join(F.broadcast(v), C("p_size") >= C("low")).groupBy("p_partkey").agg(F.max("index").alias("rung"))


@query("SELECT n_nationkey, i FROM nation, generate_series(1, 9, 2) g(i)")
def series_cross(spark, t, d):
    return joins.join(t("nation").select("n_nationkey"), F.broadcast(series(spark, 1, 9, 2)), F.lit(True))


@query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT x.o_custkey, x.n FROM a x JOIN a y ON x.o_custkey = y.o_custkey + 1 AND x.n > y.n")
def cte_rows(spark, t, d):
    a = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    y = a.select((C("o_custkey") + 1).alias("o_custkey"), C("n").alias("m"))
    return joins.join(a, y, "o_custkey").where("n > m").select("o_custkey", "n")


# --- joins -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 450000")
def join_inner(spark, t, d):
    o = t("orders").where("o_totalprice > 450000")
    oc = joins.join(o, t("customer"), C("o_custkey") == C("c_custkey"))
    return joins.join(oc, joins.checked_broadcast(t("nation")), C("c_nationkey") == C("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000) SELECT c_custkey, o_orderkey FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def join_left(spark, t, d):
    o = t("orders").where("o_orderstatus = 'P' AND o_totalprice > 300000")
    return joins.join(t("customer"), o, C("o_custkey") == C("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 18 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS m FROM supplier WHERE s_nationkey > 5 GROUP BY 1) SELECT c.k AS ck, s.k AS sk, n, m FROM c FULL JOIN s ON c.k = s.k")
def join_full(spark, t, d):
    c = t("customer").where("c_acctbal > 5000 AND c_nationkey < 18").groupBy(C("c_nationkey").alias("ck")).agg(F.count("*").alias("n"))
    s = t("supplier").where("s_nationkey > 5").groupBy(C("s_nationkey").alias("sk")).agg(F.count("*").alias("m"))
    return joins.join(c, s, C("ck") == C("sk"), "full").select("ck", "sk", "n", "m")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, r_regionkey AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey <= a.n_regionkey OR NOT r_regionkey BETWEEN 1 AND 3")
def join_theta(spark, t, d):
    n = t("nation")
    a, b = n.select(C("n_nationkey").alias("a"), "n_regionkey"), n.select(C("n_nationkey").alias("b"), C("n_regionkey").alias("rb"))
    ab = joins.join(a, b, (C("n_regionkey") == C("rb")) & (C("a") < C("b")))
    return joins.join(ab, F.broadcast(t("region")), (C("r_regionkey") <= C("n_regionkey")) | ~C("r_regionkey").between(1, 3)).select("a", "b", C("r_regionkey").alias("r"))


@query("WITH o AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT c_custkey, coalesce(top, -1.0) AS top FROM customer LEFT JOIN o ON o_custkey = c_custkey")
def join_gap_fill(spark, t, d):
    o = t("orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    out = joins.join(t("customer"), o, C("o_custkey") == C("c_custkey"), "left")
    return joins.gap_fill(out, top=F.lit(-1.0)).select("c_custkey", "top")


@query("SELECT s_suppkey, s_acctbal > (SELECT avg(s_acctbal) FROM supplier) AS above FROM supplier")
def broadcast_single(spark, t, d):
    s = t("supplier")
    return joins.beside(s, s.agg(F.avg("s_acctbal").alias("mean"))).select("s_suppkey", (C("s_acctbal") > C("mean")).alias("above"))


# --- grouping -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderdate, o_orderkey), ',') AS keys, count(*) AS n, min(o_orderkey) AS first_ord FROM orders GROUP BY 1")
def group_array_agg(spark, t, d):
    keys = grouping.gathered(C("o_orderkey"), C("o_orderdate"), C("o_orderkey"))
    return grouping.group(t("orders"), ["o_custkey"], C("o_orderkey"), keys.alias("k"), F.count("*").alias("n")).select("o_custkey", F.array_join(C("k").cast("array<string>"), ",").alias("keys"), "n", "first_ord")


@query("SELECT c_nationkey, coalesce(array_to_string(list(nullif(c_mktsegment, 'BUILDING') ORDER BY c_custkey) FILTER (WHERE c_mktsegment <> 'BUILDING'), ','), '') AS segs FROM customer GROUP BY 1")
def array_agg_filter(spark, t, d):
    seg = F.nullif(C("c_mktsegment"), F.lit("BUILDING"))
    return t("customer").groupBy("c_nationkey").agg(F.array_join(grouping.gathered(seg, C("c_custkey")), ",").alias("segs"))


@query("SELECT array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names, count(*) AS n FROM nation")
def global_array_agg(spark, t, d):
    return t("nation").agg(F.array_join(grouping.gathered(C("n_name"), C("n_nationkey")), ",").alias("names"), F.count("*").alias("n"))


@query("SELECT r_regionkey, (SELECT array_to_string(list(n_name ORDER BY n_nationkey), ',') FROM nation WHERE n_nationkey < 4) AS names FROM region")
def array_gather(spark, t, d):
    g = t("nation").where("n_nationkey < 4").agg(grouping.gathered(C("n_name"), C("n_nationkey")).alias("a"))
    return grouping.with_subquery_array(t("region").select("r_regionkey"), g, "a").select("r_regionkey", F.array_join("a", ",").alias("names"))


@query("SELECT n_regionkey, array_to_string(list(n_name || ':' || CAST(n_nationkey AS VARCHAR) ORDER BY n_nationkey), ';') AS pairs FROM nation GROUP BY 1")
def array_gather_struct(spark, t, d):
    g = t("nation").groupBy("n_regionkey").agg(grouping.gathered(F.struct("n_name", "n_nationkey"), C("n_nationkey")).alias("a"))
    return g.select("n_regionkey", F.array_join(F.transform("a", lambda x: F.concat(x["n_name"], F.lit(":"), x["n_nationkey"].cast("string"))), ";").alias("pairs"))


# --- spans ----------------------------------------------------------------------------------------------------------------------

MERGE = f"""WITH e AS ({EV}), c AS (SELECT user_id, event_id, event_type, t AS s, t + value * 30 AS z FROM e WHERE {{0}}),
f AS (SELECT *, CASE WHEN s - max(z) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3600 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS run FROM f)
SELECT user_id, round(min(s), 3) AS start_t, round(max(z), 3) AS end_t, count(*) AS n_rows, string_agg(event_type, ' ' ORDER BY s, event_id) AS text, min_by(event_id, (s, event_id)) AS event_id FROM g GROUP BY user_id, run"""


def merged(t, test: str) -> DataFrame:
    e = epoch(t("events")).where(test).select("user_id", "event_id", C("event_type").alias("text"), C("t").alias("start_t"), (C("t") + C("value") * 30).alias("end_t"))
    out = spans.merge_runs(e, 3600.0, ["user_id"], ["event_id"], text="text", others=["event_id"])
    return out.select("user_id", F.round("start_t", 3).alias("start_t"), F.round("end_t", 3).alias("end_t"), "n_rows", "text", "event_id")


@query(MERGE.format("true"))
def merge_runs(spark, t, d):
    return merged(t, "true")


@query(MERGE.format("event_type <> 'view' AND value > 5"))
def merge_runs_filtered(spark, t, d):
    return merged(t, "event_type <> 'view' AND value > 5")


@query(f"""WITH e AS ({EV}), r AS (SELECT user_id, event_id, event_type, t, t + 60 AS tick_end, floor(t / 86400) * 86400 AS s FROM e),
c AS (SELECT *, CAST(greatest(0, floor((t - s) / 20000)) AS BIGINT) AS cut FROM r)
SELECT user_id, s + cut * 20000 AS span_start, round(least(max_by(tick_end, t), s + cut * 20000 + 20000), 3) AS span_end, count(*) AS n_rows, max_by(event_type, t) AS event_type FROM c GROUP BY user_id, s, cut""")
def merge_spans(spark, t, d):
    e = epoch(t("events")).select("user_id", "event_type", "t", (C("t") + 60).alias("tick_end"), (F.floor(C("t") / 86400) * 86400.0).alias("s"))
    return spans.merge_spans(e, 20000.0, ["user_id"], "t", "tick_end", "s", ["event_type"]).withColumn("span_end", F.round("span_end", 3))


@query("SELECT user_id, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS win_start, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS n FROM events GROUP BY 1, 2")
def rms_window(spark, t, d):
    return windows.time_windows(t("events"), "ts", "6 hours", None, ["user_id"], F.round(F.sqrt(F.avg(C("value") * C("value"))), 6).alias("rms"), F.count("*").alias("n")).drop("win_end")


@query("""WITH s AS (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 20 THEN 1 ELSE 0 END AS step FROM events)
SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS shot FROM s""")
def change_points(spark, t, d):
    return spans.change_points(t("events"), "value", 20.0, ["user_id"], ["ts", "event_id"]).select("event_id", "shot")


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY 1, 2""")
def key_group_stats(spark, t, d):
    g = spans.key_groups(t("events"), C("event_type") == "purchase", ["user_id"], ["ts", "event_id"])
    return g.groupBy("user_id", "grp").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"WITH e AS ({EV}) SELECT event_id, round(t, 3) AS start_t, round(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t), 3) AS end_t FROM e")
def captions_until_next(spark, t, d):
    return spans.captions_until_next(epoch(t("events")), "t", ["user_id"], ["event_id"]).select("event_id", F.round("start_t", 3).alias("start_t"), F.round("end_t", 3).alias("end_t"))


@query(f"WITH e AS ({EV}), n AS (SELECT *, (t + lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 2 AS h FROM e) SELECT event_id, round(t, 3) AS t FROM n UNION ALL SELECT event_id, round(h, 3) FROM n WHERE h IS NOT NULL")
def double_rows(spark, t, d):
    return spans.midpoints(epoch(t("events")).select("event_id", "user_id", "t"), "t", ["user_id"], ["event_id"]).select("event_id", F.round("t", 3).alias("t"))


@query(f"WITH e AS ({EV}) SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")
def recent_extent(spark, t, d):
    return spans.recent_extent(epoch(t("events")), "value", 7200.0, "t", ["user_id"]).select("event_id", "low", "high")


@query("SELECT event_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)")
def mask_select(spark, t, d):
    keep = t("events").where("event_type = 'error' AND value > 20").select("user_id").distinct()
    return t("events").join(keep, "user_id", "left_semi").select("event_id", "event_type")


# --- order, limit, sets ------------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, seg, CAST(row_number() OVER (ORDER BY seg DESC NULLS FIRST, c_custkey) AS INTEGER) AS place FROM (SELECT * FROM c ORDER BY seg DESC NULLS FIRST, c_custkey LIMIT 400)")
def order_nulls(spark, t, d):
    from pyspark.sql import Window

    c = Relation.of(t("customer").select("c_custkey", F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("seg")), "c_custkey")
    top = c.limit([("seg", "desc")], 400)
    return top.withColumn("place", F.row_number().over(Window.orderBy(direction(C("seg"), "desc"), "c_custkey")))


@query("WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) SELECT c_custkey, seg, row_number() OVER (ORDER BY seg DESC NULLS FIRST, c_custkey) AS place FROM c")
def order_nulls_all(spark, t, d):
    """The place of every customer, where ``order_nulls`` has the first 400."""
    c = Relation.of(t("customer").select("c_custkey", F.nullif(C("c_mktsegment"), F.lit("BUILDING")).alias("seg")), "c_custkey")
    return c.placed(("seg", "desc"))


@query("SELECT o_orderkey, o_totalprice * -1 AS o_totalprice FROM orders ORDER BY o_totalprice * -1, o_orderkey LIMIT 25")
def order_alias(spark, t, d):
    return Relation.of(t("orders"), "o_orderkey").project("o_orderkey", (C("o_totalprice") * -1).alias("o_totalprice")).limit([("o_totalprice", "asc")], 25)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(spark, t, d):
    return Relation.of(t("orders").where("o_orderstatus = 'F'"), "o_orderkey").project("o_orderkey", "o_orderdate").limit([("o_orderdate", "desc")], 20, 10)


COSINE = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS c FROM embeddings, q)"""


def nearest_to_first(t, k: int) -> DataFrame:
    e = t("embeddings")
    q = e.where("vec_id = 0").select("embedding").limit(1).collect()[0][0]
    return vectors.ranked(e, "embedding", q, k, "vec_id")


@query(COSINE + "SELECT vec_id, label, round(c, 6) AS score FROM s ORDER BY c DESC, vec_id LIMIT 10")
def topk_vector(spark, t, d):
    return nearest_to_first(t, 10).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(COSINE + ", r AS (SELECT * FROM s ORDER BY c DESC, vec_id LIMIT 30) SELECT label, count(*) AS n, min(vec_id) AS first_id FROM r GROUP BY 1")
def rank_then_resort(spark, t, d):
    return nearest_to_first(t, 30).groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


@query("SELECT 0 AS branch, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 1, s_name, s_acctbal FROM supplier WHERE s_acctbal > 9000 UNION ALL SELECT 2, s_name, s_acctbal FROM supplier WHERE false")
def union_all_ordered(spark, t, d):
    c = Relation.of(t("customer").where("c_acctbal > 9000").select(C("c_name").alias("name"), C("c_acctbal").alias("bal"), "c_custkey"), "c_custkey")
    s = Relation.of(t("supplier").select(C("s_name").alias("name"), C("s_acctbal").alias("bal"), "s_suppkey"), "s_suppkey")
    out = c.project("name", "bal").union_all(s.where(C("bal") > 9000).project("name", "bal"), s.where(F.lit(False)).project("name", "bal"))
    return out.df.select(C("__ord.branch").alias("branch"), "name", "bal")


@query(f"""WITH e AS ({EV}), a AS (SELECT event_id, t FROM e WHERE event_type = 'purchase'), b AS (SELECT event_id, t FROM e WHERE event_type = 'error')
SELECT event_id, 0 AS branch, round(t - (SELECT min(t) FROM a), 3) AS t FROM a UNION ALL SELECT event_id, 1, round(t - (SELECT min(t) FROM b) + (SELECT max(t) + 1 - min(t) FROM a), 3) FROM b""")
def union_shared_clock(spark, t, d):
    e = epoch(t("events")).select("event_id", "event_type", "t").withColumn("length", F.lit(1.0))
    out = stitch([e.where("event_type = 'purchase'"), e.where("event_type = 'error'")])
    return out.select("event_id", "branch", F.round("t", 3).alias("t"))


# --- run-time predicates ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS DOUBLE) >= 50")
def rowfilter_json(spark, t, d):
    return t("events").where(P.Rows("props").compare("k", "ge", 50)).select("event_id")


ODD = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{"k": ' || CAST(event_id % 100 AS VARCHAR) || ', "s": "' || event_type || '"}' WHEN 1 THEN '{"k": "text", "s": "x"}' WHEN 2 THEN '{"k": null}' WHEN 3 THEN '{"s": "' || event_type || '", "b": true}' WHEN 4 THEN '[1]' ELSE '{"k": 7, "b": false}' END AS m FROM events"""


def odd_rows(t) -> DataFrame:
    k, e = C("event_id") % 6, C("event_type")
    m = F.when(k == 0, F.concat(F.lit('{"k": '), (C("event_id") % 100).cast("string"), F.lit(', "s": "'), e, F.lit('"}'))).when(k == 1, F.lit('{"k": "text", "s": "x"}')).when(k == 2, F.lit('{"k": null}')).when(k == 3, F.concat(F.lit('{"s": "'), e, F.lit('", "b": true}'))).when(k == 4, F.lit("[1]")).otherwise(F.lit('{"k": 7, "b": false}'))
    return t("events").select("event_id", m.alias("m"))


@query(f"WITH o AS ({ODD}) SELECT event_id FROM o WHERE (event_id % 6 = 5) OR (event_id % 6 = 0 AND event_id % 100 < 50)")
def rowfilter_tristate(spark, t, d):
    # k < 50 or b: an undecided first operand drops the row though b could decide (rows of kind 3)
    r = P.Rows("m")
    return odd_rows(t).where(P.any_of(r.compare("k", "lt", 50), r.compare("b", "eq", True))).select("event_id")


@query(f"WITH o AS ({ODD}) SELECT event_id FROM o WHERE event_id % 6 IN (0, 3) AND event_id IN (SELECT event_id FROM events WHERE event_type LIKE '%ic_' OR lower(event_type) LIKE 'e%')")
def rowfilter_like(spark, t, d):
    r = P.Rows("m")
    return odd_rows(t).where(P.any_of(r.like("s", "%ic_"), r.like("s", "E%", fold=True))).select("event_id")


@query(f"WITH o AS ({ODD}) SELECT event_id FROM o WHERE (event_id % 6 = 0 AND event_id % 100 IN (12, 24, 36)) OR (event_id % 6 = 3 AND event_id IN (SELECT event_id FROM events WHERE event_type NOT IN ('view', 'click')))")
def rowfilter_quantified(spark, t, d):
    r = P.Rows("m")
    return odd_rows(t).where(F.coalesce(r.among("k", [12, 24, 36]), F.lit(False)) | F.coalesce(P.all_of(r.compare("b", "eq", True), r.not_among("s", ["view", "click"])), F.lit(False))).select("event_id")


# --- pairing ------------------------------------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS h, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, CAST(floor(epoch_us(ts) / 3600e6) AS BIGINT) AS h, max(value) AS w FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT user_id, h, v, w FROM a JOIN b USING (user_id, h)")
def pair_lockstep(spark, t, d):
    e = t("events").withColumn("h", F.floor(F.unix_micros(C("ts").cast("timestamp")) / 3600e6))
    side = lambda kind, n: e.where(C("event_type") == kind).groupBy("user_id", "h").agg(F.max("value").alias(n))
    return pairing.lockstep(side("view", "v"), side("click", "w"), ["user_id"], "h")


def ticks_and_held(t) -> tuple[DataFrame, DataFrame]:
    e = epoch(t("events")).select("event_id", "user_id", "event_type", "t", "value")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "t"), e.where("event_type = 'view'").select("user_id", "t", C("value").alias("shown"), C("event_id").alias("view_id"))


HOLD = f"WITH e AS ({EV}), p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, t, value AS shown, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) = 1 AS newest FROM e WHERE event_type = 'view')"


@query(HOLD + " SELECT p.event_id, v.view_id, v.shown FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def pair_hold(spark, t, d):
    p, v = ticks_and_held(t)
    return pairing.hold(p, v, ["user_id"], "t", ["shown", "view_id"], tie="view_id").select("event_id", "view_id", "shown")


@query(HOLD + " SELECT p.event_id, CASE WHEN v.newest AND p.t > v.t + 7200 THEN NULL ELSE v.view_id END AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def pair_hold_linger(spark, t, d):
    p, v = ticks_and_held(t)
    return pairing.hold(p, v, ["user_id"], "t", ["view_id"], linger=7200.0, unbounded=False, tie="view_id").select("event_id", "view_id")


@query(HOLD + " SELECT p.event_id, coalesce(v.shown, -1.0) AS shown, CASE WHEN v.view_id IS NULL THEN 'programme' ELSE 'feed' END AS source FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t")
def switch_hold_coalesce(spark, t, d):
    p, v = ticks_and_held(t)
    out = pairing.hold(p, v, ["user_id"], "t", ["shown", "view_id"], tie="view_id")
    return out.select("event_id", F.coalesce("shown", F.lit(-1.0)).alias("shown"), F.when(C("view_id").isNull(), "programme").otherwise("feed").alias("source"))


INTERVAL = f"""WITH e AS ({EV}), k AS (SELECT user_id, t, event_id, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), CAST('inf' AS DOUBLE)) AS until FROM e WHERE event_type = 'purchase'),
m AS (SELECT user_id, t AS mt, event_id AS mid FROM e WHERE event_type = 'click')
SELECT mid, arg_min(k.event_id, k.t) AS tick_event_id FROM m JOIN k ON m.user_id = k.user_id AND k.t <= m.mt AND m.mt < k.until + {{0}} GROUP BY mid"""


def paired_messages(t, ahead: float) -> DataFrame:
    e = epoch(t("events"))
    ticks = e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    messages = e.where("event_type = 'click'").select("user_id", C("t").alias("mt"), C("event_id").alias("mid"))
    return pairing.interval(ticks, messages, ["user_id"], "t", "mt", ["mid"], ["event_id"], ahead).select("mid", "tick_event_id")


@query(INTERVAL.format("0"))
def pair_interval(spark, t, d):
    return paired_messages(t, 0.0)


@query(INTERVAL.format("5400"))
def pair_interval_ahead(spark, t, d):
    return paired_messages(t, 5400.0)


@query(f"WITH e AS ({EV}), w AS (SELECT user_id AS u, event_id AS win, t AS s, t + 3600 AS z, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nx FROM e WHERE event_type = 'error') SELECT event_id, win FROM e JOIN w ON user_id = u AND t >= s AND t < least(z, coalesce(nx, z)) WHERE event_type = 'view'")
def pair_rows_in_windows(spark, t, d):
    e = epoch(t("events"))
    w = e.where("event_type = 'error'").select("user_id", C("event_id").alias("win"), C("t").alias("s"), (C("t") + 3600).alias("z"))
    return pairing.rows_in_windows(e.where("event_type = 'view'").select("event_id", "user_id", "t"), w, ["user_id"], "t", "s", "z", ["win"]).select("event_id", "win")


@query(f"WITH e AS ({EV}) SELECT event_id, round(t - min(t) OVER (PARTITION BY user_id) + 10, 3) AS t FROM e")
def restamp_first_frame(spark, t, d):
    return pairing.shifted(epoch(t("events")), "t", ["user_id"], 10.0).select("event_id", F.round("t", 3).alias("t"))


# --- windows --------------------------------------------------------------------------------------------------------------------------------

NUM = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events), f AS (SELECT *, CASE WHEN n >= {0} THEN (n - {0}) // {1} + 1 ELSE 0 END AS full_ FROM r)"


@query(NUM.format(5, 5) + " SELECT user_id, rn // 5 AS win, count(*) AS n, round(sum(value), 2) AS total FROM f WHERE rn // 5 < full_ GROUP BY 1, 2")
def window_tumbling_count(spark, t, d):
    w = windows.count_windows(t("events"), 5, 5, ["user_id"], ["ts", "event_id"], tail=False)
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(NUM.format(6, 2) + " SELECT user_id, k AS win, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM f, generate_series(0, rn // 2) g(k) WHERE k < full_ AND rn < k * 2 + 6 GROUP BY 1, 2")
def window_sliding_count(spark, t, d):
    w = windows.count_windows(t("events"), 6, 2, ["user_id"], ["ts", "event_id"], tail=False)
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(NUM.format(7, 3) + " SELECT user_id, full_ AS win, count(*) AS n, min(event_id) AS first_id FROM f WHERE rn >= full_ * 3 GROUP BY 1, 2")
def window_tail(spark, t, d):
    w = windows.count_windows(t("events"), 7, 3, ["user_id"], ["ts", "event_id"]).where("tail")
    return w.groupBy("user_id", "win").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


WINDOW_SQL = "WITH w AS (SELECT *, unnest([time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '30 minutes', ts, TIMESTAMP '1970-01-01') - INTERVAL '30 minutes']) AS win_start FROM events) SELECT event_type, win_start, win_start + INTERVAL '1 hour' AS win_end, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY 1, 2"


def counts() -> tuple:
    return F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")


@query(WINDOW_SQL)
def window_time(spark, t, d):
    return windows.time_windows(t("events"), "ts", "1 hour", "30 minutes", ["event_type"], *counts())


@query(f"WITH e AS ({EV}) SELECT event_id, round(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), -1), 3) AS until FROM e")
def tick_interval(spark, t, d):
    return windows.tick_intervals(epoch(t("events")), "t", ["user_id"], ["event_id"]).select("event_id", F.round(F.when(C("until") == float("inf"), -1.0).otherwise(C("until")), 3).alias("until"))


@query(f"WITH e AS ({EV}), b AS (SELECT user_id, CAST(floor(min(t) / 21600) AS BIGINT) AS a, CAST(floor(max(t) / 21600) AS BIGINT) AS z FROM e GROUP BY 1) SELECT user_id, k * 21600.0 AS t FROM b, generate_series(a, z) g(k)")
def rate_clock(spark, t, d):
    return windows.spine(epoch(t("events")), ["user_id"], "t", 21600.0)


# --- functions ----------------------------------------------------------------------------------------------------------------------------------

FUNCTIONS = udfs.Registry()
FUNCTIONS.declare("net", lambda price, discount, tax: F.round(price * (1 - discount) * (1 + tax), 6), price=udfs.REQUIRED, discount=udfs.REQUIRED, tax=0.0)
FUNCTIONS.declare("top_items", lambda df, k: df.withColumn("items", F.slice(F.sort_array(F.transform("items", lambda x: x["l_extendedprice"]), asc=False), 1, k)).select("o_orderkey", F.explode("items").alias("price")), df=udfs.REQUIRED, k=2)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) * 1.0, 6) AS plain, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS taxed FROM lineitem WHERE l_quantity = 50")
def fn_default_named(spark, t, d):
    f = FUNCTIONS["net"]
    l = t("lineitem").where("l_quantity = 50")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f(C("l_extendedprice"), C("l_discount")).alias("plain"), f(C("l_extendedprice"), tax=C("l_tax"), discount=C("l_discount")).alias("taxed"))


@query("WITH k AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)) SELECT l_orderkey AS o_orderkey, l_extendedprice AS price FROM k WHERE r <= 3")
def fn_table_lateral(spark, t, d):
    return FUNCTIONS["top_items"](lines(t), k=3)


LETTERS = ", ".join(f"(length(text) - length(regexp_replace(lower(text), '[{''.join(chr(97 + k) for k in range(26) if k % 8 == b)}]', '', 'g')))" for b in range(8))


@query(f"WITH c AS (SELECT conv_id, turn, list_transform([{LETTERS}], lambda x: CAST(x AS DOUBLE)) AS v FROM conversations) SELECT conv_id, turn, round(CASE WHEN list_sum(v) = 0 THEN 0 ELSE v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 6) AS v1, round(CASE WHEN list_sum(v) = 0 THEN 0 ELSE v[5] / sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 6) AS v5 FROM c")
def udf_embed(spark, t, d):
    v = udfs.letter_counts(C("text"))
    return t("conversations").select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.round(C("v")[0], 6).alias("v1"), F.round(C("v")[4], 6).alias("v5"))


@query("SELECT conv_id, turn, length(text) AS chars, turn % 2 = 0 AS even FROM conversations WHERE role = 'user'")
def rows_udtf(spark, t, d):
    def f(b):
        b = b[b.role == "user"]
        return b.assign(chars=b.text.str.len(), even=b.turn % 2 == 0)

    return udfs.rows_function(t("conversations"), f, "conv_id long, turn long, chars int, even boolean")


# --- flagship ------------------------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH k AS ({NESTED}), r AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) / 1e6 AS s, l_extendedprice FROM orders JOIN k ON l_orderkey = o_orderkey WHERE l_discount >= 0.05),
o AS (SELECT o_custkey, o_orderkey, s, sum(l_extendedprice) AS total FROM r GROUP BY 1, 2, 3),
f AS (SELECT *, CASE WHEN s - max(s + 86400) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 2592000 THEN 0 ELSE 1 END AS fresh FROM o),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS run FROM f)
SELECT o_custkey, run, min(s) AS start_t, max(s + 86400) AS end_t, count(*) AS n_orders, round(sum(total), 2) AS total FROM g GROUP BY 1, 2 ORDER BY total DESC NULLS FIRST, o_custkey LIMIT 10""")
def flagship_runs(spark, t, d):
    """Discounted items of nested orders, merged into runs of a customer's orders, the ten largest."""
    rows = unnest(lines(t).select("o_custkey", "o_orderkey", "o_orderdate", "items"), "items", "l").where(C("l.l_discount") >= 0.05)
    o = rows.groupBy("o_custkey", "o_orderkey", "o_orderdate").agg(F.sum("l.l_extendedprice").alias("total"))
    o = epoch(o, "o_orderdate", "start_t").withColumn("end_t", C("start_t") + 86400)
    w = spans.merge_runs(o, 2592000.0, ["o_custkey"], ["o_orderkey"], others=[])
    # totals of a run come from the rows it holds
    keyed = spans.runs_of(o, 2592000.0, ["o_custkey"], ["o_orderkey"]).groupBy("o_custkey", "run").agg(F.round(F.sum("total"), 2).alias("total"))
    out = w.join(keyed, ["o_custkey", "run"]).withColumnRenamed("n_rows", "n_orders")
    return Relation.of(out, "o_custkey").limit([("total", "desc")], 10).select("o_custkey", "run", "start_t", "end_t", "n_orders", "total")


# --- streaming --------------------------------------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') AS win_start, time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 hour' AS win_end, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, t, d):
    return streams.last_batch(streams.drain(streams.windowed(streams.events(spark, d), "ts", "1 hour", None, ["event_type"], *counts()), "complete"))


@query(WINDOW_SQL)
def stream_sliding(spark, t, d):
    return streams.last_batch(streams.drain(streams.windowed(streams.events(spark, d), "ts", "1 hour", "30 minutes", ["event_type"], *counts()), "complete"))


@query("""WITH f AS (SELECT *, CASE WHEN ts - max(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
SELECT user_id, min(ts) AS start_t, max(ts) + INTERVAL '2 hours' AS end_t, count(*) AS n FROM g GROUP BY user_id, run""")
def stream_session_merge(spark, t, d):
    return streams.last_batch(streams.drain(streams.sessions(streams.events(spark, d), "ts", "2 hours", ["user_id"], F.count("*").alias("n")), "complete"))


@query("SELECT a.event_id, (SELECT max_by(v.event_id, v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = a.user_id AND v.ts <= a.ts) AS view_id FROM events a WHERE a.event_type = 'purchase'")
def stream_hold(spark, t, d):
    def step(now, row):
        if row.event_type == "view":
            now["view_id"] = int(row.event_id)
            return []
        return [(row.event_id, None if now["view_id"] < 0 else now["view_id"])] if row.event_type == "purchase" else []

    fold = streams.KeyedFold(step, {"view_id": -1}, "event_id long, view_id long", "view_id long", ["ts", "event_id"])
    return streams.drain(fold(streams.events(spark, d), ["user_id"]))


@query("WITH k AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM events WHERE event_type = 'purchase') SELECT m.event_id AS mid, k.event_id AS tick_event_id FROM events m JOIN k ON m.user_id = k.user_id AND m.ts >= k.ts AND (until IS NULL OR m.ts < until) WHERE m.event_type = 'click'")
def stream_interval(spark, t, d):
    def step(now, row):
        if row.event_type == "purchase":
            now["tick"] = int(row.event_id)
            return []
        return [(row.event_id, now["tick"])] if row.event_type == "click" and now["tick"] >= 0 else []

    fold = streams.KeyedFold(step, {"tick": -1}, "mid long, tick_event_id long", "tick long", ["ts", "event_id"])
    return streams.drain(fold(streams.events(spark, d), ["user_id"]))


@query("WITH a AS (SELECT *, epoch_us(ts) / 1e6 + CASE WHEN event_id % 17 = 0 THEN 9000 ELSE event_id % 5 END AS arrival FROM events), m AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a) SELECT event_id FROM m WHERE newest IS NULL OR epoch_us(newest) / 1e6 - epoch_us(ts) / 1e6 <= 600")
def stream_leaky(spark, t, d):
    """Rows in order of arrival; one older than the newest passed or seen by more than ten minutes is let go."""

    def step(now, row):
        at = row.ts.timestamp()
        keep = now["newest"] - at <= 600
        now["newest"] = max(now["newest"], at)
        return [(row.event_id,)] if keep else []

    e = streams.events(spark, d).withColumn("arrival", F.unix_micros(C("ts").cast("timestamp")) / F.lit(1e6) + F.when(C("event_id") % 17 == 0, 9000).otherwise(C("event_id") % 5))
    fold = streams.KeyedFold(step, {"newest": -1e18}, "event_id long", "newest double", ["arrival", "event_id"])
    return streams.drain(fold(e, ["user_id"]))


@query("SELECT event_type AS sink, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def stream_fanout(spark, t, d):
    base = streams.base_dir(spark)
    put = lambda kind: lambda df, b: df.where(C("event_type") == kind).write.mode("overwrite").parquet(f"{base}/{kind}/{b}")
    streams.fan_out(streams.events(spark, d), [put("view"), put("click")])
    schema = t("events").schema
    out = [spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{base}/{k}") for k in ("view", "click")]
    return out[0].unionByName(out[1]).groupBy(C("event_type").alias("sink")).agg(*counts())


# --- sources ------------------------------------------------------------------------------------------------------------------------------------------------

VTT = "WEBVTT\n\nintro\n00:01.000 --> 00:02.500\nHello\nthere\n\n01:00:03.250 --> 01:00:04.000 align:start\nBye\n\nNOTE nothing\n"


@query("WITH v(track, index, text, start_t, end_t) AS (VALUES ('a', 1, 'Hello' || chr(10) || 'there', 1.0, 2.5), ('a', 2, 'Bye', 3603.25, 3604.0)) SELECT * FROM v")
def caption_cues(spark, t, d):
    return captions(spark.createDataFrame([("a", VTT), ("b", "no cues"), ("c", None)], "track string, text string"))


MANIFEST = """#EXTM3U
#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1,mp4a"
low.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=2400000,RESOLUTION=1280x720
mid.m3u8
"""


@query("WITH v(path, index, bandwidth, height, uri) AS (VALUES ('p', 1, 800000, 360, 'low.m3u8'), ('p', 2, 2400000, 720, 'mid.m3u8')) SELECT * FROM v")
def rendition_rows(spark, t, d):
    return renditions(spark.createDataFrame([("p", MANIFEST)], "path string, text string")).select("path", "index", "bandwidth", "height", "uri")


@query("SELECT o_orderpriority AS dest, count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
def sink_fan_out(spark, t, d):
    """Rows written one folder a group and read back."""
    out = f"{streams.base_dir(spark)}/fan"
    sinks.fan_out(t("orders").where("o_totalprice > 400000"), "o_orderpriority", out)
    back = spark.read.parquet(out)
    return back.groupBy(C("o_orderpriority").alias("dest")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT user_id, t FROM (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r % 10 = 0")
def note_rows(spark, t, d):
    """Every tenth row of a user."""
    return windows.numbered(epoch(t("events")), ["user_id"], ["ts", "event_id"]).where((C("rn") + 1) % 10 == 0).select("user_id", "t")


def by_dialect(spark, t, text: str, *names: str) -> DataFrame:
    return dialect.query(spark, text, {n: t(n) for n in names})


@query("SELECT n_nationkey, n_name || '/' || r_name AS place, CASE WHEN n_nationkey < 10 THEN 'low' ELSE 'high' END AS half FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2 WHERE n_nationkey BETWEEN 3 AND 20")
def dialect_join(spark, t, d):
    return by_dialect(spark, t, "SELECT n.n_nationkey, n.n_name || '/' || r.r_name AS place, CASE WHEN n.n_nationkey < 10 THEN 'low' ELSE 'high' END AS half FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey <> 2 WHERE n.n_nationkey BETWEEN 3 AND 20", "nation", "region")


@query("SELECT s_suppkey, CASE WHEN s_nationkey - 12 < 0 THEN -((12 - s_nationkey) // 5) ELSE (s_nationkey - 12) // 5 END AS q, upper(s_name) AS u FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 15")
def dialect_order(spark, t, d):
    return by_dialect(spark, t, "WITH top AS (SELECT s_suppkey, s_nationkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 15) SELECT s_suppkey, (s_nationkey - 12) / 5 AS q, upper(s_name) AS u FROM top", "supplier")


@query("SELECT n_regionkey AS r, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY 1")
def dialect_gather(spark, t, d):
    # the table's own order is by key; a CTE makes it the row order
    out = by_dialect(spark, t, "WITH o AS (SELECT n_regionkey, n_name, n_nationkey FROM nation) SELECT n_regionkey AS r, array_agg(n_name) AS names FROM o GROUP BY n_regionkey", "nation")
    return out.select("r", F.array_join("names", ",").alias("names"))


@query("SELECT g, r.name AS name FROM generate_series(1, 6) x(g) JOIN (VALUES (1, 'a'), (4, 'b')) r(k, name) ON g >= r.k UNION ALL SELECT 0, n_name FROM nation WHERE n_nationkey = 7")
def dialect_rows(spark, t, d):
    text = "SELECT g, r.name FROM generate_series(1, 6) g JOIN unnest(ARRAY[STRUCT(1 AS k, 'a' AS name), STRUCT(4 AS k, 'b' AS name)]) r ON g >= r.k UNION ALL SELECT 0 AS g, n_name FROM nation WHERE n_nationkey = :n"
    return dialect.query(spark, text, {"nation": t("nation")}, variables={"n": "7"})


from spanloom.plans import cases  # noqa: E402, F401  (registers its queries)
