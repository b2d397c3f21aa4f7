"""More registered queries: sources, sinks, refusals, latency, ready-made parts. Imported by ``queries``."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanloom.errors import DialectError
from spanloom.functions import predicates as P
from spanloom.functions import udfs, values
from spanloom.operators import modules, pairing, windows
from spanloom.operators.relation import Relation
from spanloom.plans import dialect, latency, script
from spanloom.plans.queries import EV, HOLD, NUM, C, lines, query
from spanloom.sources import sinks, tables
from spanloom.sources.tables import epoch
from spanloom.streaming import lateness, lateral, streams

# --- sources -------------------------------------------------------------------------------------------------------


def text_of(spark, t, form: str, **options) -> str:
    """The nations written to a folder of their own."""
    path = f"{streams.base_dir(spark)}/nations"
    t("nation").write.format(form).options(**options).save(path)
    return path


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def input_options(spark, t, d):
    """A delimited source with reader options and a declared shape."""
    path = text_of(spark, t, "csv", sep="|", header=True)
    return tables.read(spark, path, "csv", "n_nationkey int, n_name string, n_regionkey int", sep="|", header=True)


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS motto FROM nation")
def declared_shape(spark, t, d):
    """A declared shape decides the columns: what the files lack is NULL."""
    return tables.read(spark, text_of(spark, t, "json"), "json", "n_nationkey int, n_name string, motto string")


@query("SELECT 'a' AS tag, n_nationkey AS k FROM nation UNION ALL SELECT 'b', n_nationkey FROM nation WHERE n_nationkey < 5")
def named_inputs(spark, t, d):
    """Inputs named by rows, the other fields as columns."""
    small = f"{streams.base_dir(spark)}/small"
    t("nation").where("n_nationkey < 5").write.parquet(small)
    rows = tables.named_inputs(spark, [{"path": f"{d}/nation.parquet", "tag": "a"}, {"path": small, "tag": "b"}])
    return rows.select("tag", C("n_nationkey").alias("k"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def titled_track(spark, t, d):
    return tables.titled(t("conversations"), "user", "role").select("conv_id", "turn", "text")


@query("SELECT n.n_nationkey AS a, m.n_nationkey AS b FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey AND n.n_nationkey < m.n_nationkey")
def input_twice(spark, t, d):
    """One input under two aliases: equal path and options are one scan, so that the plan reads the files once."""
    path = f"{d}/nation.parquet"
    return dialect.query(spark, f"SELECT n.n_nationkey AS a, m.n_nationkey AS b FROM input('{path}') n JOIN input('{path}') m ON n.n_regionkey = m.n_regionkey AND n.n_nationkey < m.n_nationkey")


@query("SELECT l_orderkey AS o_orderkey, l_partkey AS part, l_quantity AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 45")
def dialect_lateral(spark, t, d):
    nested = lines(t).select("o_orderkey", "items")
    return dialect.query(spark, "SELECT o.o_orderkey, e.l_partkey AS part, e.l_quantity AS quantity FROM o, LATERAL unnest(o.items) e WHERE e.l_quantity > 45", {"o": nested})


@query("SELECT o_orderkey, o_totalprice * 0.9 - 10 AS net, CASE WHEN o_totalprice * 0.9 - 10 >= 200000 THEN 'F:big' ELSE 'F:small' END AS tag FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000")
def dialect_function(spark, t, d):
    """Functions of a script: defaults, arguments by name, one function in another, and a table with a parameter."""
    return dialect.query(
        spark,
        """CREATE FUNCTION net(price number, share number DEFAULT 0.9, fee number DEFAULT 0) RETURNS number AS $$ SELECT price * share - fee $$ LANGUAGE sql;
        CREATE FUNCTION size_of(price number) RETURNS text AS $$ SELECT CASE WHEN net(price, fee => 10) >= 200000 THEN 'big' ELSE 'small' END $$ LANGUAGE sql;
        CREATE FUNCTION dear(least number, status text DEFAULT 'F') RETURNS TABLE(k number, price number, s text)
          AS $$ SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS s FROM o WHERE o_orderstatus = status AND o_totalprice > least $$ LANGUAGE sql;
        SELECT d.k AS o_orderkey, net(d.price, fee => 10) AS net, d.s || ':' || size_of(d.price) AS tag FROM dear(150000) d""",
        {"o": t("orders")},
    )


@query("SELECT r_regionkey, count(*) AS n, CAST(r_regionkey AS BIGINT) AS number FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def lateral_messages(spark, t, d):
    """A sub-query run once for each message, one after another, with the message's fields bound."""
    out = f"{streams.base_dir(spark)}/runs"

    def run(message, number):
        rows = t("nation").where(C("n_regionkey") == message.r_regionkey).groupBy().agg(F.count("*").alias("n"))
        rows.select(F.lit(message.r_regionkey).alias("r_regionkey"), "n", F.lit(number).cast("long").alias("number")).write.mode("append").parquet(out)

    lateral.per_message(t("region"), ["r_regionkey"], run)
    return spark.read.parquet(out)


@query("WITH v(input, finished) AS (VALUES ('batch', true), ('stream', false)) SELECT * FROM v")
def liveness(spark, t, d):
    rows = [("batch", tables.bounded(t("events"))), ("stream", tables.bounded(streams.events(spark, d)))]
    return spark.createDataFrame(rows, "input string, finished boolean")


@query("WITH v(index, title, start_t, end_t) AS (VALUES (1, 'Intro', 0.0, 1.0), (2, 'Rest', 1.0, 4.0)) SELECT * FROM v")
def chapter_records(spark, t, d):
    """Written rows as records of a declared type."""
    return dialect.query(spark, "WITH c AS (SELECT STRUCT(r.index AS index, r.name AS title, r.a AS start_t, r.b AS end_t)::chapter AS c FROM unnest(ARRAY[STRUCT('Intro' AS name, 0.0 AS a, 1.0 AS b), STRUCT('Rest' AS name, 1.0 AS a, 4.0 AS b)]) r) SELECT c.c.* FROM c")


@query("SELECT p_partkey, p_brand AS item, 1 AS index FROM part UNION ALL SELECT p_partkey, p_type, 2 FROM part")
def source_files(spark, t, d):
    """The items of a comma list as rows."""
    return modules.listed(t("part").select("p_partkey", F.concat("p_brand", F.lit(", "), "p_type").alias("list")), "list", "item")


@query("WITH v(index, t, key, bytes) AS (VALUES (1, 0.0, true, 900), (2, 0.04, false, 120), (3, 0.08, false, 130)) SELECT * FROM v")
def source_replay(spark, t, d):
    rows = [{"t": 0.0, "key": True, "bytes": 900}, {"t": 0.04, "key": False, "bytes": 120}, {"t": 0.08, "key": False, "bytes": 130}]
    return tables.struct_rows(spark, rows, "t double, key boolean, bytes int")


# --- sinks ---------------------------------------------------------------------------------------------------------


def as_lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.rstrip("\n").split("\n"), 1)), "line int, text string")


@query("""WITH w AS (SELECT max(length(r_name)) AS n FROM region), r AS (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS k FROM region)
SELECT 1 AS line, ' key | name' AS text UNION ALL SELECT 2, repeat('-', 5) || '+' || repeat('-', CAST((SELECT n FROM w) AS INTEGER) + 2)
UNION ALL SELECT CAST(k AS INTEGER) + 2, rtrim(' ' || rpad(CAST(r_regionkey AS VARCHAR), 3, ' ') || ' | ' || r_name) FROM r UNION ALL SELECT CAST(count(*) AS INTEGER) + 3, '(' || CAST(count(*) AS VARCHAR) || ' rows)' FROM region""")
def sink_table(spark, t, d):
    """Rows as the printed table."""
    return as_lines(spark, sinks.render_table(t("region").orderBy("r_regionkey").select(C("r_regionkey").alias("key"), C("r_name").alias("name"))))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) SELECT 1 AS line, 'n_nationkey,n_name' AS text UNION ALL SELECT CAST(k AS INTEGER) + 1, CAST(n_nationkey AS VARCHAR) || ',' || n_name FROM r")
def sink_csv(spark, t, d):
    return as_lines(spark, sinks.render_csv(t("nation").orderBy("n_nationkey").select("n_nationkey", "n_name")))


@query("SELECT n_nationkey AS k, n_name AS name, CASE WHEN n_regionkey <> 1 THEN n_regionkey END AS region FROM nation")
def sink_json(spark, t, d):
    """One JSON array, NULL cells spelled out, read back."""
    rows = t("nation").select(C("n_nationkey").alias("k"), C("n_name").alias("name"), F.nullif("n_regionkey", F.lit(1)).alias("region"))
    return spark.createDataFrame([tuple(r.values()) for r in json.loads(sinks.render_json(rows))], "k int, name string, region int")


@query("""SELECT '{"n_nationkey":' || CAST(n_nationkey AS VARCHAR) || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def sink_ndjson(spark, t, d):
    path = f"{streams.base_dir(spark)}/rows.ndjson"
    sinks.write(t("nation").select("n_nationkey", "n_name"), path)
    return spark.read.text(path)


@query("SELECT n_nationkey, '[' || CAST(n_nationkey * 0.5 AS DOUBLE)::VARCHAR || ', 1.25, 2.0, 3.0, ... (5)]' AS shown, '[' || CAST(n_nationkey * 0.5 AS DOUBLE)::VARCHAR || ', 1.25, 2.0, 3.0, 4.0]' AS whole FROM nation")
def vector_cells(spark, t, d):
    """A vector is cut short on the screen and whole in a file."""
    rows = t("nation").select("n_nationkey", F.array(C("n_nationkey") * F.lit(0.5), F.lit(1.25), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("v"))
    kind = rows.schema["v"].dataType
    return spark.createDataFrame([(r.n_nationkey, sinks.spell(r.v, kind, False), sinks.spell(r.v, kind, True)) for r in sinks.printed(rows)], "n_nationkey int, shown string, whole string")


@query("SELECT n_regionkey, '{' || array_to_string(list('(' || CAST(n_nationkey AS VARCHAR) || ',' || n_name || ')' ORDER BY n_nationkey), ',') || '}' AS cell FROM nation GROUP BY 1")
def record_cells(spark, t, d):
    rows = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("a"))
    kind = rows.schema["a"].dataType
    return spark.createDataFrame([(r.n_regionkey, sinks.spell(r.a, kind, True)) for r in sinks.printed(rows)], "n_regionkey int, cell string")


@query("SELECT count(*) AS n, max(o_orderkey) AS top FROM orders")
def sink_one_path(spark, t, d):
    """A path of its own takes exactly one row."""
    path = f"{streams.base_dir(spark)}/one.json"
    sinks.write_one(t("orders").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top")), path)
    return spark.read.schema("n long, top long").json(path)


COPIES = """CREATE VIEW f AS SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000;
COPY (SELECT o_orderkey FROM f) TO '{0}/keys.json';
COPY (SELECT o_orderkey, o_totalprice FROM f WHERE o_totalprice > 400000) TO '{0}/rows.csv' WITH (header);"""


@query("SELECT 'json' AS form, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000 UNION ALL SELECT 'csv', o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000")
def script_copies(spark, t, d):
    """A view and two COPY statements; the paths' endings name the forms."""
    base = streams.base_dir(spark)
    dialect.run(spark, COPIES.format(base), {"orders": t("orders")})
    a = spark.read.schema("o_orderkey long").json(f"{base}/keys.json").select(F.lit("json").alias("form"), "o_orderkey")
    return a.unionByName(spark.read.schema("o_orderkey long, o_totalprice double").csv(f"{base}/rows.csv", header=True).select(F.lit("csv").alias("form"), "o_orderkey"))


@query("SELECT o_orderkey, o_orderpriority AS priority, CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE o_totalprice > 400000")
def sink_tags(spark, t, d):
    """Only tags and disposition are written beside the rows' own columns."""
    rows = t("orders").where("o_totalprice > 400000").select("o_orderkey", F.create_map(F.lit("priority"), C("o_orderpriority"), F.lit("customer"), C("o_custkey").cast("string")).alias("tags"))
    path = f"{streams.base_dir(spark)}/tagged"
    sinks.write_tagged(rows, path, reserved=("codec", "duration"))
    back = spark.read.parquet(path)
    return back.select("o_orderkey", C("tags")["priority"].alias("priority"), C("tags")["customer"].alias("customer"))


@query("SELECT 'event ' || CAST(event_id AS VARCHAR) || ' ' || event_type AS line FROM events")
def sink_effects(spark, t, d):
    """A sink whose effects are its output: a line a row, micro-batch by micro-batch."""
    base = streams.base_dir(spark)
    line = F.concat(F.lit("event "), C("event_id").cast("string"), F.lit(" "), C("event_type")).alias("value")
    modules.effects(streams.events(spark, d), lambda df, b: df.select(line).write.mode("overwrite").text(f"{base}/{b}"), timeout=600)
    return spark.read.option("recursiveFileLookup", True).text(base).select(C("value").alias("line"))


# --- projection, filters, values --------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS p, n_name AS q FROM nation WHERE n_regionkey = 2")
def struct_expansion(spark, t, d):
    return dialect.query(spark, "SELECT (STRUCT(n_nationkey AS p, n_name AS q)).* FROM nation WHERE n_regionkey = 2", {"nation": t("nation")})


@query("SELECT p_partkey, p_size FROM part")
def where_assertion(spark, t, d):
    """An assertion that holds for every row lets all pass."""
    return Relation.of(t("part"), "p_partkey").check(C("p_size") > 0, "a part without size").project("p_partkey", "p_size").frame()


@query("SELECT l_orderkey AS o_orderkey, count(*) AS a, count(*) AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def array_lengths(spark, t, d):
    return dialect.query(spark, "SELECT o_orderkey, array_length(items, 1) AS a, cardinality(items) AS b FROM o", {"o": lines(t).select("o_orderkey", "items")}).select("o_orderkey", C("a").cast("long"), C("b").cast("long"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def vector_lengths(spark, t, d):
    return t("embeddings").select("vec_id", values.vector_length(C("embedding")).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '5-LOW'")
def list_variables(spark, t, d):
    text = "SELECT o_orderkey FROM orders WHERE o_orderstatus = :'status' OR o_orderpriority = :wanted[2]"
    return dialect.query(spark, text, {"orders": t("orders")}, variables={"status": "P", "wanted": "'1-URGENT', '5-LOW'"})


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def partial_aggregates(spark, t, d):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, event_id, value, false AS is_total FROM events UNION ALL SELECT user_id, CAST(NULL AS BIGINT), round(sum(value), 2), true FROM events GROUP BY user_id")
def row_and_total(spark, t, d):
    return modules.rows_and_total(t("events"), ["user_id"], ["event_id", "value"], {"value": F.round(F.sum("value"), 2)})


# --- run-time predicates -------------------------------------------------------------------------------------------------

NESTED_ROWS = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN '{"a": {"k": "x"}, "k": ' || CAST(event_id % 20 AS VARCHAR) || '}' WHEN 1 THEN '{"k": ' || CAST(event_id % 20 AS VARCHAR) || ', "a": {"k": "x"}}' WHEN 2 THEN '{"a": [{"k": 50}]}' WHEN 3 THEN '{"k": "50"}' ELSE '{"q\\": 1, \\"k": 50}' END AS m FROM events"""


def nested_rows(t) -> DataFrame:
    k, v = C("event_id") % 5, (C("event_id") % 20).cast("string")
    m = F.when(k == 0, F.concat(F.lit('{"a": {"k": "x"}, "k": '), v, F.lit("}"))).when(k == 1, F.concat(F.lit('{"k": '), v, F.lit(', "a": {"k": "x"}}')))
    return t("events").select("event_id", m.when(k == 2, F.lit('{"a": [{"k": 50}]}')).when(k == 3, F.lit('{"k": "50"}')).otherwise(F.lit('{"q\\": 1, \\"k": 50}')).alias("m"))


@query(f"WITH o AS ({NESTED_ROWS}) SELECT event_id FROM o WHERE event_id % 5 IN (0, 1) AND event_id % 20 >= 5")
def rowfilter_nested(spark, t, d):
    """Only the object's own field counts: not one of the same name further in, in a text or of another type."""
    return nested_rows(t).where(P.Rows("m").compare("k", "ge", 5)).select("event_id")


@query("SELECT event_id FROM events")
def rowfilter_empty(spark, t, d):
    """AND of nothing holds, OR of nothing doesn't."""
    return t("events").where(P.all_of() & ~P.any_of()).select("event_id")


@query("WITH v(field, literal, code) AS (VALUES ('k', 'text', 'UDF_ARG_TYPE'), ('s', 'number', 'UDF_ARG_TYPE'), ('k', 'number', 'ok'), ('free', 'text', 'ok')) SELECT * FROM v")
def rowfilter_literal_types(spark, t, d):
    """A literal must have the type that a row's field is declared with."""
    rows = P.Rows("props", kinds={"k": "number", "s": "string"})
    out = []
    for field, kind, literal in (("k", "text", "x"), ("s", "number", 1), ("k", "number", 2.5), ("free", "text", "x")):
        try:
            rows.compare(field, "eq", literal)
            out.append((field, kind, "ok"))
        except DialectError as e:
            out.append((field, kind, e.code))
    return spark.createDataFrame(out, "field string, literal string, code string")


# --- refusals ------------------------------------------------------------------------------------------------------------


def verdicts(spark, t, texts: list[str]) -> DataFrame:
    """The code with which each script is refused, or ok."""
    return spark.createDataFrame([(k, dialect.validate(spark, x, {"nation": t("nation"), "region": t("region"), "embeddings": t("embeddings")})) for k, x in enumerate(texts, 1)], "script int, code string")


def expected(*codes: str) -> str:
    return "WITH v(script, code) AS (VALUES " + ", ".join(f"({k}, '{c}')" for k, c in enumerate(codes, 1)) + ") SELECT * FROM v"


@query(expected(*["UNSUPPORTED_SQL"] * 4, "ok"))
def refused_filters(spark, t, d):
    return verdicts(spark, t, ["SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", "SELECT n_name FROM nation WHERE n_name LIKE 'A%'", "SELECT n_name FROM nation WHERE EXISTS (SELECT r_regionkey FROM region)", "SELECT n_name FROM nation GROUP BY n_regionkey HAVING n_regionkey > 1", "SELECT n_name FROM nation WHERE n_nationkey > 3"])


@query(expected(*["UNSUPPORTED_SQL"] * 4, "ok"))
def refused_joins(spark, t, d):
    on = "ON n.n_regionkey = r.r_regionkey"
    return verdicts(spark, t, [f"SELECT n.n_name FROM nation n RIGHT JOIN region r {on}", "SELECT n.n_name FROM nation n CROSS JOIN region r", "SELECT n.n_name FROM nation n NATURAL JOIN region r", "SELECT n.n_name FROM nation n JOIN region r USING (r_regionkey)", f"SELECT n.n_name FROM nation n FULL OUTER JOIN region r {on}"])


@query(expected(*["UNSUPPORTED_SQL"] * 4, "ok"))
def refused_aggregates(spark, t, d):
    return verdicts(spark, t, ["SELECT count(n_name) FROM nation", "SELECT max(n_nationkey) FROM nation", "SELECT n_name, array_agg(n_nationkey) AS a FROM nation GROUP BY n_regionkey", "SELECT array_agg(n_name ORDER BY n_name) AS a FROM nation", "SELECT array_agg(n_name) AS a FROM nation"])


@query(expected(*["UNSUPPORTED_SQL"] * 4, "ok"))
def refused_sets(spark, t, d):
    a, b = "SELECT n_name AS x FROM nation", "SELECT r_name AS x FROM region"
    return verdicts(spark, t, [f"{a} UNION {b}", f"{a} INTERSECT {b}", "SELECT DISTINCT n_name FROM nation", f"{a} UNION ALL SELECT r_regionkey, r_name FROM region", f"{a} UNION ALL {b}"])


@query(expected(*["UNSUPPORTED_SQL"] * 2, *["UNKNOWN_FUNCTION"] * 2, "UDF_ARG_TYPE", "UDF_ARG_TYPE", "UDF_ARG_TYPE"))
def refused_functions(spark, t, d):
    """Window frames, unknown functions, keys that have no order, vectors where a text or number belongs."""
    return verdicts(spark, t, ["SELECT length(n_name) OVER (ORDER BY n_name) FROM nation", "SELECT n_name FROM nation WINDOW w AS (ORDER BY n_name)", "SELECT sqrt(n_nationkey) FROM nation", "SELECT lenght(n_name) FROM nation", "SELECT vec_id FROM embeddings ORDER BY embedding", "SELECT embedding::text AS e FROM embeddings", "SELECT vec_id FROM embeddings WHERE embedding = embedding"])


@query(expected("SYNTAX_ERROR", "INPUT_NOT_FOUND", "UNKNOWN_ALIAS", "UNSUPPORTED_SQL", "SYNTAX_ERROR", "UNKNOWN_SINK_OPTION", "ok"))
def typed_errors(spark, t, d):
    """Whatever is wrong with a script has a code."""
    return verdicts(spark, t, ["SELECT n_name, FROM nation", "SELECT x FROM nowhere", "SELECT n.nme FROM nation n", "CREATE VIEW v AS SELECT n_name FROM nation; SELECT r_name FROM region", "SELECT ) FROM nation", "COPY (SELECT n_name FROM nation) TO 'x.csv' WITH (colour red)", "CREATE VIEW v AS SELECT n_name FROM nation; SELECT n_name FROM v"])


@query("WITH v(index, name, needed) AS (VALUES (1, 'path', true), (2, 'level', false)) SELECT * FROM v")
def variables_header(spark, t, d):
    """The variables that a script declares in its header comment."""
    text = "-- variables: path, level = 3\nSELECT n_name FROM nation"
    return spark.createDataFrame([(k, n, default is None) for k, (n, default) in enumerate(script.header(text).items(), 1)], "index int, name string, needed boolean")


# --- latency ---------------------------------------------------------------------------------------------------------------

GRAPH = [
    latency.Stage("camera", live=True),
    latency.Stage("speech", [latency.Input("camera")], window=3.0),
    latency.Stage("notes", [latency.Input("speech")], latency=0.5),
    latency.Stage("show", [latency.Input("camera", bytes_per_second=300e6), latency.Input("notes", "interval", ahead=1.0), latency.Input("speech", "hold")], live=True),
]


@query("WITH v(stage, delay) AS (VALUES ('camera', 0.0), ('speech', 3.0), ('notes', 3.5), ('show', 4.5)) SELECT * FROM v")
def static_latency(spark, t, d):
    return spark.createDataFrame(list(latency.delays(GRAPH).items()), "stage string, delay double")


@query("WITH v(bound, result) AS (VALUES (2.0, 'LIVE_LEAD'), (5.0, 'ok')) SELECT * FROM v")
def live_lead(spark, t, d):
    """A live stage refuses an interval input that is later than its bound."""
    out = []
    for bound in (2.0, 5.0):
        try:
            latency.check([*GRAPH[:3], latency.Stage("show", [latency.Input("camera"), latency.Input("notes", "interval", ahead=1.0, bound=bound)], live=True)])
            out.append((bound, "ok"))
        except DialectError as e:
            out.append((bound, e.code))
    return spark.createDataFrame(out, "bound double, result string")


@query("WITH v(warning) AS (VALUES ('HELD_STREAM: camera waits with 1287 MiB at show')) SELECT * FROM v")
def held_stream(spark, t, d):
    return spark.createDataFrame([(w,) for w in latency.check(GRAPH)], "warning string")


# --- pairing -----------------------------------------------------------------------------------------------------------------


def sides(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = epoch(t("events")).select("event_id", "user_id", "event_type", "t", "value")
    kind = lambda k: e.where(C("event_type") == k)
    return kind("purchase").select("event_id", "user_id", "t"), kind("view").select("user_id", "t", C("event_id").alias("view_id")), kind("click").select("user_id", "t", C("event_id").alias("click_id"))


@query(HOLD + " SELECT v.view_id AS row_id, p.event_id AS frame_id FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.t >= p.t")
def pair_at_or_before(spark, t, d):
    """Each row with the frame at or before it."""
    p, v, _ = sides(t)
    return pairing.at_or_before(v, p.withColumnRenamed("event_id", "frame_id"), ["user_id"], "t", ["frame_id"], tie="frame_id").select(C("view_id").alias("row_id"), "frame_id")


@query(HOLD + " SELECT p.event_id, CASE WHEN p.t <= v.t - 600 + 10800 THEN v.view_id END AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t - 600")
def pair_hold_timeout(spark, t, d):
    """Held rows shown ten minutes ahead; a feed that is silent for three hours ends."""
    p, v, _ = sides(t)
    return pairing.hold(p, v, ["user_id"], "t", ["view_id"], tie="view_id", lead=600.0, timeout=10800.0).select("event_id", "view_id")


@query(f"""WITH e AS ({EV}), p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), v AS (SELECT user_id, t, event_id AS view_id FROM e WHERE event_type = 'view'), c AS (SELECT user_id, t, event_id AS click_id FROM e WHERE event_type = 'click'),
z AS (SELECT user_id, max(t) + 1800 AS z FROM (SELECT user_id, t FROM v UNION ALL SELECT user_id, t FROM c) GROUP BY 1),
a AS (SELECT p.*, v.view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.t >= v.t), b AS (SELECT a.*, c.click_id FROM a ASOF LEFT JOIN c ON a.user_id = c.user_id AND a.t >= c.t)
SELECT event_id, CASE WHEN t <= z THEN view_id END AS view_id, CASE WHEN t <= z THEN click_id END AS click_id FROM b LEFT JOIN z USING (user_id)""")
def pair_hold_group(spark, t, d):
    """Two inputs held as one group: both end half an hour after the last row of either."""
    p, v, c = sides(t)
    return pairing.hold_group(p, {"view_id": v, "click_id": c}, ["user_id"], "t", linger=1800.0).select("event_id", "view_id", "click_id")


@query(f"""WITH e AS ({EV}), k AS (SELECT user_id, t, event_id, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), CAST('inf' AS DOUBLE)) AS until FROM e WHERE event_type = 'purchase'),
m AS (SELECT user_id, t AS mt, event_id AS mid, t + CASE WHEN event_id % 7 = 0 THEN 5000 ELSE 5 END AS seen FROM e WHERE event_type = 'click')
SELECT mid, k.event_id AS tick_event_id, false AS late FROM m JOIN k ON m.user_id = k.user_id AND k.t <= m.mt AND m.mt < k.until WHERE seen - mt <= 60
UNION ALL SELECT mid, arg_min(k.event_id, k.t), true FROM m JOIN k ON m.user_id = k.user_id AND k.t >= m.seen WHERE seen - mt > 60 GROUP BY mid""")
def pair_interval_late(spark, t, d):
    """A message that comes more than a minute after its time goes to the next tick and is reported late."""
    e = epoch(t("events"))
    ticks = e.where("event_type = 'purchase'").select("user_id", "t", "event_id")
    messages = e.where("event_type = 'click'").select("user_id", C("t").alias("mt"), C("event_id").alias("mid"), (C("t") + F.when(C("event_id") % 7 == 0, 5000).otherwise(5)).alias("seen"))
    return pairing.interval_or_late(ticks, messages, ["user_id"], "t", "mt", "seen", 60.0, ["mid"], ["event_id"]).select("mid", "tick_event_id", "late")


@query("SELECT event_id, 'view' AS input FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 'click' FROM events WHERE event_type = 'click'")
def pair_arrival(spark, t, d):
    """Unpaired: rows of every input as they come."""
    e = t("events").select("event_id", "event_type")
    return pairing.arrival({k: e.where(C("event_type") == k).select("event_id") for k in ("view", "click")})


@query(f"WITH e AS ({EV}) SELECT event_id, 'shared-clock' AS anchor, round(t, 3) AS t FROM e UNION ALL SELECT event_id, 'first-frame', round(t - min(t) OVER (PARTITION BY user_id), 3) FROM e UNION ALL SELECT event_id, 'tagged', round(t + value, 3) FROM e")
def pair_anchors(spark, t, d):
    """The three ways in which a source's time is put on the clock."""
    e, out = epoch(t("events")), None
    for how in ("shared-clock", "first-frame", "tagged"):
        one = pairing.anchored(e, "t", ["user_id"], how, tag="value").select("event_id", F.lit(how).alias("anchor"), F.round("t", 3).alias("t"))
        out = one if out is None else out.unionByName(one)
    return out


# --- ready-made parts -----------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS grp, coalesce(ts < lag(ts) OVER w, false) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS bytes, NOT bool_or(back) AS ordered FROM s GROUP BY 1, 2""")
def packet_stats(spark, t, d):
    return modules.group_summary(t("events"), C("event_type") == "purchase", ["user_id"], "ts", ["event_id"], F.length("props"))


@query("SELECT 'events' AS input, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'none', 0")
def packet_tally(spark, t, d):
    return modules.tally({"events": t("events"), "orders": t("orders"), "none": modules.quiet(t("orders"))})


@query(f"WITH e AS ({EV}) SELECT event_id, round(t, 3) AS t, event_type = 'purchase' AS key, CAST(length(props) AS INTEGER) AS bytes FROM e")
def packet_keys(spark, t, d):
    """A row a packet, read once from the scan with its declared shape."""
    e = epoch(tables.read(spark, f"{d}/events.parquet", "parquet", t("events").schema))
    return e.select("event_id", F.round("t", 3).alias("t"), (C("event_type") == "purchase").alias("key"), F.length("props").alias("bytes"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def packet_head(spark, t, d):
    return modules.head(t("events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@query(f"WITH e AS ({EV}), p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), c AS (SELECT user_id, t FROM e WHERE event_type = 'click') SELECT p.event_id, count(c.t) AS seen, round(max(c.t), 3) AS latest FROM p LEFT JOIN c ON c.user_id = p.user_id AND c.t <= p.t GROUP BY 1")
def shape_state(spark, t, d):
    p, _, c = sides(t)
    return modules.running_state(p, c, ["user_id"], "t", ["event_id"]).select("event_id", "seen", F.round("latest", 3).alias("latest"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) - 1 AS rn FROM events) SELECT user_id, CAST(rn // 8 AS BIGINT) AS win, min(ts) AS ts, count(*) AS n, round(sum(value), 2) AS total FROM r GROUP BY 1, 2")
def sample_recut(spark, t, d):
    """Samples of hourly packets cut anew into eights."""
    packets = t("events").groupBy("user_id", F.window("ts", "1 hour")).agg(F.collect_list(F.struct("ts", "value")).alias("samples"))
    return modules.recut(packets, ["user_id"], "samples", "ts", 8).withColumn("total", F.round("total", 2))


@query(f"WITH e AS ({EV}), k AS (SELECT user_id, event_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), CAST('inf' AS DOUBLE)) AS until FROM e WHERE event_type = 'purchase') SELECT k.event_id, count(m.t) AS n FROM k LEFT JOIN e m ON m.user_id = k.user_id AND m.event_type = 'view' AND m.t >= k.t AND m.t < k.until GROUP BY 1")
def shape_recut(spark, t, d):
    """How many samples each tick's interval takes."""
    p, v, _ = sides(t)
    paired = pairing.interval(p, v.withColumnRenamed("t", "mt"), ["user_id"], "t", "mt", ["view_id"], ["event_id"]).groupBy(C("tick_event_id").alias("event_id")).agg(F.count("*").alias("n"))
    return p.select("event_id").join(paired, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'view' AS input, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE event_type = 'view' UNION ALL SELECT 'error', count(*), round(sum(value), 2) FROM events WHERE event_type = 'error'")
def shape_sink(spark, t, d):
    """Totals of each input of an arrival sink at its end."""
    e = t("events")
    return pairing.arrival({k: e.where(C("event_type") == k).select("value") for k in ("view", "error")}).groupBy("input").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ordinal FROM events")
def run_ordinal(spark, t, d):
    """Run-wide numbers that don't depend on how many tasks dealt with the rows."""
    rows = Relation.of(t("events").select("event_id", "ts").repartition(7), "event_id")
    return rows.placed(("ts", "asc"), name="ordinal").select("event_id", "ordinal")


@query(f"WITH e AS ({EV}), w AS (SELECT user_id, event_id AS span_id, t AS s, t + 1800 AS z FROM e WHERE event_type = 'error') SELECT e.event_id, span_id, round(s, 3) AS block_start FROM e JOIN w ON e.user_id = w.user_id AND e.t >= s AND e.t < z WHERE event_type = 'view'")
def spot_rows(spark, t, d):
    """A row for each tick while a span is in view, keyed by the span's start."""
    e = epoch(t("events"))
    spans = e.where("event_type = 'error'").select("user_id", C("event_id").alias("span_id"), C("t").alias("s"), (C("t") + 1800).alias("z"))
    return modules.in_view(spans, e.where("event_type = 'view'").select("event_id", "user_id", "t"), ["user_id"], "t", "s", "z").select("event_id", "span_id", F.round("s", 3).alias("block_start"))


@query("SELECT event_id, left(rtrim(props), length(rtrim(props)) - 1) || ',\"id\":' || CAST(event_id AS VARCHAR) || '}' AS body FROM events")
def data_stamp(spark, t, d):
    return modules.stamped(t("events").select("event_id", C("props").alias("body")), "body", {"id": C("event_id")})


@query(f"WITH e AS ({EV}) SELECT event_id, 'main' AS pad, round(t, 3) AS pts, CAST(length(props) AS INTEGER) AS bytes FROM e")
def data_echo(spark, t, d):
    return epoch(t("events")).select("event_id", F.lit("main").alias("pad"), F.round("t", 3).alias("pts"), F.octet_length("props").alias("bytes"))


@query("SELECT event_id FROM events WHERE false")
def quiet_rows(spark, t, d):
    return modules.quiet(t("events")).select("event_id")


@query(f"WITH e AS ({EV}), b AS (SELECT user_id, CAST(floor(max(t) / 3600) AS BIGINT) - CAST(floor(min(t) / 3600) AS BIGINT) + 1 AS beats, count(*) AS n FROM e GROUP BY 1) SELECT * FROM b")
def heartbeat(spark, t, d):
    """Beats of programme time beside the rows; modules see the rows alone."""
    rows = modules.with_beats(epoch(t("events")).select("user_id", "t", "event_id"), ["user_id"], "t", 3600.0)
    beats = rows.where("beat").groupBy("user_id").agg(F.count("*").alias("beats"))
    return beats.join(modules.without_beats(rows).groupBy("user_id").agg(F.count("*").alias("n")), "user_id")


@query("SELECT 'first' AS port, 1 AS n, n_nationkey AS k FROM nation UNION ALL SELECT 'many', 1, r_regionkey FROM region UNION ALL SELECT 'many', 2, s_nationkey FROM supplier")
def port_rows(spark, t, d):
    """An optional port left off, and one that takes several streams."""
    key = lambda name, c: t(name).select(C(c).alias("k"))
    return modules.ports(key("nation", "n_nationkey"), None, [key("region", "r_regionkey"), key("supplier", "s_nationkey")])


@query(NUM.format(5, 5) + " SELECT user_id, rn // 5 AS win, round(max(value) - min(value), 4) AS reach FROM f WHERE rn // 5 < full_ GROUP BY 1, 2")
def stream_function(spark, t, d):
    """A function over the rows of each window."""
    w = windows.count_windows(t("events").select("user_id", "ts", "event_id", "value"), 5, 5, ["user_id"], ["ts", "event_id"], tail=False)
    return modules.window_function(w.select("user_id", "win", "value"), reach, ["user_id", "win"], "user_id long, win long, reach double")


def reach(rows):
    out = rows.iloc[:1][["user_id", "win"]].copy()
    out["reach"] = round(float(rows.value.max() - rows.value.min()), 4)
    return out


WEIGHTED = udfs.Registry()
WEIGHTED.declare("weighted", lambda columns, weights: sum((c * w for c, w in zip(columns, weights, strict=True)), F.lit(0)), columns=udfs.REQUIRED, weights=udfs.REQUIRED)
WEIGHTED.declare("banded", lambda value, bands: F.coalesce(*(F.when(value >= b["low"], b["name"]) for b in sorted(bands, key=lambda b: -b["low"])), F.lit("none")), value=udfs.REQUIRED, bands=udfs.REQUIRED)


@query("SELECT p_partkey, p_size * 3 + p_partkey * 2 AS score, CASE WHEN p_size >= 30 THEN 'big' WHEN p_size >= 10 THEN 'mid' ELSE 'none' END AS band FROM part")
def fn_list_params(spark, t, d):
    """Array and record-list parameters."""
    score = WEIGHTED["weighted"]([C("p_size"), C("p_partkey")], weights=[3, 2])
    band = WEIGHTED["banded"](C("p_size"), bands=[{"low": 10, "name": "mid"}, {"low": 30, "name": "big"}])
    return t("part").select("p_partkey", score.cast("long").alias("score"), band.alias("band"))


# --- streaming ----------------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT *, epoch_us(ts) / 1e6 AS t, epoch_us(ts) / 1e6 + CASE WHEN event_id % 5 = 0 THEN 90000 ELSE 1 END AS arrival FROM events),
m AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a) SELECT event_id FROM m WHERE newest IS NULL OR t >= newest""")
def stream_drop_late(spark, t, d):
    """The adaptive lateness judge over rows so far apart that only its order rule can drop one."""
    e = epoch(streams.events(spark, d)).withColumn("arrival", C("t") + F.when(C("event_id") % 5 == 0, 90000.0).otherwise(1.0)).select("event_id", "user_id", "t", "arrival")
    return streams.drain(lateness.drop_late(e, ["user_id"], "arrival", "t", max_lateness=0.5, max_spread=0.0)).select("event_id")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def stream_limited(spark, t, d):
    """A table of several files read one file a micro-batch."""
    base = streams.base_dir(spark)
    t("events").repartition(4).write.parquet(f"{base}/events.parquet")
    out = streams.drain(streams.events(spark, base, files=1).select("event_type", "value"), timeout=600)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT 'flow' AS event, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def row_events(spark, t, d):
    """Figures of a run beside its rows."""
    seen = Observation("flow")
    rows = t("events").observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(C("event_type") == "error", 1)).alias("errors"))
    rows.select("event_type").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("flow", seen.get["n"], seen.get["errors"])], "event string, n long, errors long")
