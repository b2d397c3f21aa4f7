"""Operators against small hand-made cases and plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.errors import DialectError
from spanloom.functions import predicates as P
from spanloom.functions import udfs, values
from spanloom.operators import joins, pairing, spans, windows
from spanloom.operators.relation import Relation, splat
from spanloom.plans import latency
from spanloom.plans.script import Script, substitute
from spanloom.session import configure
from spanloom.sources import sinks, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_merge_runs_table(spark):
    """Touching at the distance joins; a longer earlier row keeps the run open; NULL bounds count as 0; NULL texts are skipped."""
    df = spark.createDataFrame(
        [("a", 1, 0.0, 1.0, "x"), ("a", 2, 2.0, 3.0, None), ("a", 3, 4.1, 5.0, "y"), ("b", 1, 0.0, 9.0, "p"), ("b", 2, 1.0, 2.0, "q"), ("b", 3, 9.5, 10.0, "r"), ("c", 1, None, None, None)],
        "k string, i int, start_t double, end_t double, text string",
    )
    got = rows(spans.merge_runs(df, 1.0, ["k"], ["i"], text="text"), "k", "start_t", "end_t", "n_rows", "text")
    assert got == [("a", 0.0, 3.0, 2, "x"), ("a", 4.1, 5.0, 1, "y"), ("b", 0.0, 10.0, 3, "p q r"), ("c", 0.0, 0.0, 1, "")]
    with pytest.raises(DialectError):
        spans.merge_runs(df, -1, ["k"], ["i"])


def test_merge_runs_model(spark):
    r = random.Random(2)
    data = []
    for key in range(40):
        for i in range(r.randint(0, 12)):
            s = r.randint(0, 40)
            data.append((key, i, float(s), float(s + r.randint(0, 8))))
    want = []
    for key in range(40):
        run = None
        for _, i, s, e in sorted((x for x in data if x[0] == key), key=lambda x: (x[2], x[1])):
            if run and s - run[1] <= 2:
                run[1] = max(run[1], e)
            else:
                if run:
                    want.append((key, *run))
                run = [s, e]
        if run:
            want.append((key, *run))
    df = spark.createDataFrame(data, "k int, i int, start_t double, end_t double")
    assert rows(spans.merge_runs(df, 2.0, ["k"], ["i"]), "k", "start_t", "end_t") == sorted(want)


def test_merge_spans(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 0.0, "a"), (1, 1.0, 2.0, 0.0, "b"), (1, 3.0, 4.0, 0.0, "c"), (1, 9.0, 10.0, None, "d")], "k int, t double, z double, s double, v string")
    got = rows(spans.merge_spans(df, 2.0, ["k"], "t", "z", "s", ["v"]), "span_start", "span_end", "n_rows", "v")
    assert got == [(0.0, 2.0, 2, "b"), (2.0, 4.0, 1, "c")]


def count_model(n, w, s):
    """Windows of a list of n, by the buffer that a stream would keep."""
    out, held, win = [], [], 0
    for x in range(n):
        held.append(x)
        if len(held) == w:
            out += [(win, y, False) for y in held]
            held = held[s:]
            win += 1
    return out + [(win, y, True) for y in held]


@pytest.mark.parametrize("w,s", [(1, 1), (3, 3), (4, 1), (5, 2), (7, 4)])
def test_count_windows(spark, w, s):
    data = [(n, x) for n in range(13) for x in range(n)]
    got = windows.count_windows(spark.createDataFrame(data, "k int, x int"), w, s, ["k"], ["x"])
    want = sorted((n, *r) for n in range(13) for r in count_model(n, w, s))
    assert rows(got, "k", "win", "x", "tail") == want
    with pytest.raises(DialectError):
        windows.count_windows(got, 2, 3, ["k"], ["x"])


def test_hold(spark):
    ticks = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.5), (1, 9.0), (2, 1.0)], "k int, t double")
    held = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, "b")], "k int, t double, v string")
    got = lambda **o: rows(pairing.hold(ticks, held, ["k"], "t", ["v"], **o).select("k", "t", F.coalesce("v", F.lit("-"))))
    assert got() == [(1, 0.0, "-"), (1, 1.0, "a"), (1, 2.5, "b"), (1, 9.0, "b"), (2, 1.0, "-")]
    assert got(unbounded=False) == [(1, 0.0, "-"), (1, 1.0, "a"), (1, 2.5, "-"), (1, 9.0, "-"), (2, 1.0, "-")]
    assert got(unbounded=False, linger=1.0) == [(1, 0.0, "-"), (1, 1.0, "a"), (1, 2.5, "b"), (1, 9.0, "-"), (2, 1.0, "-")]


@pytest.mark.parametrize("ahead", [0.0, 1.5])
def test_interval_model(spark, ahead):
    r = random.Random(3)
    ticks = [(k, float(t), i) for k in range(10) for i, t in enumerate(sorted(r.sample(range(60), r.randint(0, 8))))]
    msgs = [(k, r.randint(0, 119) / 2, j) for k in range(10) for j in range(9)]
    want = []
    for k, m, j in msgs:
        own = [t for t in ticks if t[0] == k]
        for n, (_, at, i) in enumerate(own):
            until = own[n + 1][1] if n + 1 < len(own) else float("inf")
            if at <= m < until + ahead:
                want.append((k, j, i))
                break
    got = pairing.interval(spark.createDataFrame(ticks, "k int, t double, i int"), spark.createDataFrame(msgs, "k int, m double, j int"), ["k"], "t", "m", ["j"], ["i"], ahead)
    assert rows(got, "k", "j", "tick_i") == sorted(want)


def undecided(node, row):
    """Reference model of the three-state predicates."""
    op = node[0]
    if op in ("and", "or"):
        for x in node[1:]:
            v = undecided(x, row)
            if v is None or v == (op == "or"):
                return v
        return op == "and"
    if op == "not":
        v = undecided(node[1], row)
        return None if v is None else not v
    _, field, lit = node
    v = row.get(field)
    if v is None or isinstance(v, bool) != isinstance(lit, bool) or isinstance(v, str) != isinstance(lit, str):
        return None
    return {"lt": v < lit, "eq": v == lit}[op]


def test_predicates_model(spark):
    import json

    r = random.Random(5)
    data = [{f: v for f, v in (("a", r.choice([1, 5, "x", True, None])), ("b", r.choice(["x", "y", 2.5])), ("c", r.choice([True, False, 0]))) if r.random() < 0.8} for _ in range(80)]

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            return (r.choice(["lt", "eq"]), r.choice("abc"), r.choice([3, "x", True]))
        op = r.choice(["and", "or", "not"])
        return (op, *(tree(depth - 1) for _ in range(1 if op == "not" else r.randint(0, 3))))

    rx = P.Rows("m")

    def column(n):
        if n[0] == "and":
            return P.all_of(*map(column, n[1:]))
        if n[0] == "or":
            return P.any_of(*map(column, n[1:]))
        return P.negate(column(n[1])) if n[0] == "not" else rx.compare(n[1], n[0], n[2])

    trees = [tree(3) for _ in range(25)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "i int, m string")
    got = df.select("i", *(column(t).alias(f"t{k}") for k, t in enumerate(trees))).collect()
    for row in got:
        for k, t in enumerate(trees):
            assert row[f"t{k}"] == undecided(t, data[row.i]), (data[row.i], t)


def test_values(spark):
    one = spark.range(1)
    got = one.select(values.divide(F.lit(-7), F.lit(2), True), values.divide(F.lit(7.0), F.lit(2), False), values.substring(F.lit("hello"), 0, 3), values.substring(F.lit("hello"), -3, 2), values.bits_per_second(F.lit("1.5Mi"))).first()
    assert tuple(got) == (-3, 3.5, "he", "", 1572864)
    with pytest.raises(Exception, match="vectors of 2 and 1"):
        one.select(values.cos_similarity(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0)))).collect()
    m = one.select(values.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"), F.lit("b"), F.lit(None).cast("string")))).first()[0]
    assert m == {"a": "3"}


def test_relation(spark):
    df = spark.createDataFrame([(1, None, [0.5]), (2, "b", [1.0]), (3, "a", [2.0])], "i int, s string, v array<double>")
    r = Relation.of(df, "i")
    assert [x.i for x in r.order_by(("s", "asc")).collect()] == [3, 2, 1]
    assert [x.i for x in r.order_by(("s", "desc")).collect()] == [1, 2, 3]
    with pytest.raises(DialectError):
        r.order_by(("v", "asc"))
    with pytest.raises(DialectError):
        r.limit([("s", "asc")], 0)
    with pytest.raises(DialectError):
        r.star(replace={"nope": F.lit(1)})
    assert r.star(leave=("v", "zz")).columns == ["i", "s"]
    with pytest.raises(Exception, match="too large"):
        r.check(F.col("i") < 3, "too large").frame().collect()
    assert [tuple(x) for x in splat(spark.createDataFrame([([1, 2],)], "a array<int>"), "a", 3).collect()] == [(1, 2, None)]


def test_joins(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 50.0)], "k int, t double")
    b = spark.createDataFrame([(1, 0.0, 60.0, "x"), (1, 4.0, 6.0, "y"), (2, 0.0, 99.0, "z"), (1, 9.0, 1.0, "never")], "k int, s double, z double, v string")
    assert rows(joins.band_join(a, b, ["k"], "t", "s", "z", 7.0), "t", "v") == [(5.0, "x"), (5.0, "y"), (50.0, "x")]
    with pytest.raises(DialectError):
        joins.beside(a, a)
    with pytest.raises(DialectError):
        joins.join(a, b, "k", "right")


def test_sources(spark):
    assert rows(tables.series(spark, 5, 1, -2)) == [(1,), (3,), (5,)]
    for bad in ((1, 5, 0), (5, 1, 1)):
        with pytest.raises(DialectError):
            tables.series(spark, *bad)
    with pytest.raises(DialectError, match="did you mean header"):
        tables.read(spark, "x", "csv", heder=True)
    with pytest.raises(DialectError):
        tables.struct_rows(spark, [{"a": 1}, {"b": 2}], "a int")
    cues = tables.captions(spark.createDataFrame([("t", "WEBVTT\r\n\r\n1\r\n00:00:01.5 --> 00:00:02.000\r\nHi\r\n")], "track string, text string"))
    assert rows(cues, "track", "index", "text", "start_t", "end_t") == [("t", 1, "Hi", 1.5, 2.0)]
    with pytest.raises(DialectError, match="there are t"):
        tables.titled(cues, "u")
    hls = '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=800,RESOLUTION=640x360,CODECS="avc1,mp4a"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=900\nhi.m3u8\n'
    got = rows(tables.renditions(spark.createDataFrame([("p", hls)], "path string, text string")), "index", "bandwidth", "width", "height", "codecs", "uri")
    assert got == [(1, 800, 640, 360, "avc1,mp4a", "low.m3u8"), (2, 900, None, None, None, "hi.m3u8")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, True, [0.5, 1.0, 2.0, 3.0, 4.0], (1, "x")), (22, "é,", False, [1.0], (2, None))], "i int, s string, b boolean, v array<double>, r struct<a:int,c:string>").orderBy("i").coalesce(1)
    lines = sinks.render_table(df).split("\n")
    assert lines[0] == " i  | s  | b     | v                             | r"
    assert lines[2] == " 1  |    | true  | [0.5, 1.0, 2.0, 3.0, ... (5)] | (1,x)"
    assert lines[-1] == "(2 rows)"
    assert sinks.render_csv(df.select("i", "s")) == 'i,s\n1,\n22,"é,"\n'
    assert '"v": [' in sinks.render_json(df)
    with pytest.raises(DialectError, match="several rows"):
        sinks.write_one(df, str(tmp_path / "one"))
    for bad in ("a/b", "..", None):
        with pytest.raises(DialectError):
            sinks.fan_out(spark.createDataFrame([(1, bad)], "i int, d string"), "d", str(tmp_path / "bad"))
    with pytest.raises(DialectError, match="two rows"):
        sinks.fan_out(spark.createDataFrame([(1, "x"), (2, "x")], "i int, d string"), "d", str(tmp_path / "two"), one_row_each=True)
    sinks.fan_out(spark.createDataFrame([(1, "x"), (2, "y")], "i int, d string"), "d", str(tmp_path / "fan"))
    assert rows(spark.read.parquet(str(tmp_path / "fan")), "i", "dest") == [(1, "x"), (2, "y")]
    with pytest.raises(DialectError, match="UNKNOWN_SINK_OPTION"):
        sinks.write(df, str(tmp_path / "x"), headr=True)


def test_functions():
    f = udfs.Registry()
    f.declare("g", lambda a, b: (a, b), a=udfs.REQUIRED, b=2)
    assert f["g"](1) == (1, 2) and f["g"](b=3, a=1) == (1, 3) and f["g"](1, None) == (1, 2)
    for args, kw in (((), {}), ((1, 2, 3), {}), ((1,), {"a": 2}), ((1,), {"c": 2})):
        with pytest.raises(DialectError):
            f["g"](*args, **kw)
    with pytest.raises(DialectError, match="UNKNOWN_FUNCTION"):
        f["h"]


def test_script(spark):
    assert substitute("select :'a', \"x:b\", ':a', :n, :l[2], x::text -- :a", {"a": "it's", "l": "1, 2"}) == "select 'it''s', \"x:b\", ':a', NULL, 2, x::text -- :a"
    with pytest.raises(DialectError):
        substitute("select 1", {"a": "1"})
    s, out = Script(), []
    s.view("a", lambda v: spark.range(3))
    s.view("b", lambda v: v["a"].where("id > 0"))
    s.copy(("b",), lambda df: out.append(df.count()))
    s.copy(("b",), lambda df: out.append(df.count()))
    s.run()
    assert out == [2, 2]
    s.view("unused", lambda v: v["a"])
    with pytest.raises(DialectError, match="nothing reads"):
        s.run()


def test_latency():
    L, I = latency.Stage, latency.Input
    plan = [L("src", latency=0.5), L("slow", [I("src")], window=3.0), L("join", [I("src", bytes_per_second=300e6), I("slow", "interval", ahead=1.0, bound=2.0)], live=True)]
    assert latency.delays(plan) == {"src": 0.5, "slow": 3.5, "join": 2.0}
    with pytest.raises(DialectError, match="LIVE_LEAD"):
        latency.check(plan)
    plan[2].inputs[1].bound = None
    assert "HELD_STREAM" in latency.check(plan)[0]
    with pytest.raises(DialectError):
        latency.delays([L("a", [I("b")]), L("b", [I("a")])])


def test_session(spark):
    configure(spark)
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "LAST_WIN"


def test_places_of_all(spark):
    """Every row has its place: NULLs first under desc, ties in row order, ranges of several tasks joined without gaps."""
    r = random.Random(9)
    rows = [(k, r.choice([None, "a", "b", "c", "d"])) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, s string").repartition(5)
    want = sorted(rows, key=lambda x: (x[1] is not None, -ord(x[1] or "~"), x[0]))
    got = sorted((x.place, x.k, x.s) for x in Relation.of(df, "k").placed(("s", "desc")).collect())
    assert got == [(i, *x) for i, x in enumerate(want, 1)]
    assert Relation.of(df.limit(0), "k").placed(("s", "desc")).count() == 0


def test_order_nulls_all(spark):
    """The order of non-null segments shows: places of all customers, the first 400 as ``order_nulls`` has them."""
    from spanloom.plans.queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = {r.place: (r.c_custkey, r.seg) for r in QUERIES["order_nulls_all"](spark, d).collect()}
    assert sorted(rows) == list(range(1, spark.read.parquet(f"{d}/customer.parquet").count() + 1))
    seen = list(dict.fromkeys(rows[k][1] for k in sorted(rows)))
    assert seen[0] is None and seen[1:] == sorted(seen[1:], reverse=True) and len(seen) == 5
    assert all(rows[r.place] == (r.c_custkey, r.seg) for r in QUERIES["order_nulls"](spark, d).collect())
