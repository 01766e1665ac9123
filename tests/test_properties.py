"""Property tests: cleaning round-trips a formatted number; filter and its
complement partition the rows."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dashframe.functions.clean import clean_numeric_text
from dashframe.operators.filters import condition_predicate
from dashframe.spec import FilterCondition


def br(v: float) -> str:
    s = f"{v:,.2f}"
    return "R$ " + s.replace(",", "#").replace(".", ",").replace("#", ".")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(min_value=-1e9, max_value=1e9, allow_nan=False), min_size=1, max_size=20))
def test_clean_round_trip(spark, values):
    texts = [(br(v), round(v, 2)) for v in values]
    df = spark.createDataFrame(texts, "t string, want double")
    got = df.select(clean_numeric_text(F.col("t")).alias("got"), "want").collect()
    for r in got:
        assert abs(r["got"] - r["want"]) < 1e-6 or r["got"] == r["want"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=0, max_size=30),
       st.integers(-50, 50))
def test_filter_and_complement_partition(spark, values, cut):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    p = condition_predicate(FilterCondition("v", "gt", cut))
    kept, rest = df.where(p).count(), df.where(~p).count()
    nulls = df.where(F.col("v").isNull()).count()
    assert kept + rest + nulls == len(values)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-20, 20)),
                min_size=1, max_size=60))
def test_box_quartiles_are_members_and_ordered(spark, data):
    from dashframe.operators.charts import box_plot
    from dashframe.spec import ChartSpec
    df = spark.createDataFrame(data, "g string, y long").repartition(3)
    for r in box_plot(df, ChartSpec("box_plot", x_column="g", y_column="y")).collect():
        vals = sorted(v for g, v in data if g == r["group"])
        n = len(vals)
        assert (r["n"], r["lower"], r["q1"], r["median"], r["q3"], r["upper"]) == \
            (n, vals[0], vals[n // 4], vals[n // 2], vals[3 * n // 4], vals[-1])


@settings(max_examples=10, deadline=None)
@given(st.dictionaries(st.integers(0, 30), st.one_of(st.none(), st.text(max_size=3)),
                       max_size=15),
       st.dictionaries(st.integers(0, 30), st.one_of(st.none(), st.text(max_size=3)),
                       max_size=15))
def test_upsert_idempotent_and_keeps_old_path(spark, old, new):
    from dashframe.operators.catalog import upsert
    schema = "k long, p string"
    o = spark.createDataFrame(list(old.items()), schema)
    n = spark.createDataFrame(list(new.items()), schema)
    once = upsert(o, n, "k", keep_if_null=["p"])
    twice = upsert(once, n, "k", keep_if_null=["p"])
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    want = dict(old)
    for k, v in new.items():
        want[k] = v if v is not None else old.get(k)
    assert a == sorted(want.items())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(-5, 5)),
                min_size=0, max_size=40), st.integers(1, 4))
def test_top_per_group_matches_brute_force(spark, data, k):
    from dashframe.operators.order import top_per_group
    rows = [(g, v, i) for i, (g, v) in enumerate(data)]
    df = spark.createDataFrame(rows, "g string, v long, id long").repartition(3)
    got = sorted((r["g"] or "", r["id"], r["rank"]) for r in
                 top_per_group(df, ["g"], [F.col("v").desc(), F.col("id").asc()], k).collect())
    want = []
    for g in {r[0] for r in rows}:
        members = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))[:k]
        want += [(g or "", r[2], pos + 1) for pos, r in enumerate(members)]
    assert got == sorted(want)
