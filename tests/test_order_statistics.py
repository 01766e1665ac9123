"""Positions, pages and quantiles must not depend on partitions or reuse."""

import pytest
from pyspark.sql import functions as F

from dashframe.operators import quantiles
from dashframe.operators.order import page, with_position
from dashframe.operators.quantiles import grouped_quantiles

SF = "/root/testdata/sf0.01"
SETTINGS = [
    {"spark.sql.shuffle.partitions": "8"},
    {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"},
    {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false"},
    {"spark.sql.shuffle.partitions": "8", "spark.sql.exchange.reuse": "false"},
]


@pytest.fixture(params=SETTINGS, ids=["plain", "many", "static", "no-reuse"])
def session(spark, request):
    before = {k: spark.conf.get(k, None) for k in request.param}
    for k, v in request.param.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_positions_pages_and_medians(session):
    orders = session.read.parquet(f"{SF}/orders.parquet").repartition(7)
    rows = sorted((r.o_totalprice, r.o_orderkey, r.o_orderstatus)
                  for r in orders.select("o_totalprice", "o_orderkey", "o_orderstatus").collect())
    order = [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()]
    placed = with_position(orders, order)
    assert placed.columns == orders.columns + ["position"]
    assert {r.o_orderkey: r.position for r in placed.select("o_orderkey", "position").collect()} \
        == {k: i + 1 for i, (_, k, _) in enumerate(rows)}
    got = page(orders, order, limit=50, offset=9000).collect()
    assert [(r.position, r.o_orderkey) for r in sorted(got, key=lambda r: r.position)] \
        == [(9001 + i, k) for i, (_, k, _) in enumerate(rows[9000:9050])]
    by = {}
    for price, _, status in rows:
        by.setdefault(status, []).append(price)
    med = grouped_quantiles(orders, ["o_orderstatus"], "o_totalprice", {"median": 0.5})
    for r in med.collect():
        v = by[r.o_orderstatus]
        assert r.n == len(v) and r.median == pytest.approx((v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2)


def positions_of(rows, key, pick):
    """By sorting each group in Python (NaN last, as Spark does)."""
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    out = {}
    for k, vs in groups.items():
        vs.sort(key=lambda v: (v != v, v if v == v else 0))
        out[k] = tuple(str(vs[f(len(vs))]) for f in pick)
    return out


PICK = [lambda n: 0, lambda n: n // 4, lambda n: n // 2, lambda n: n * 3 // 4, lambda n: n - 1]


@pytest.mark.parametrize("k,margin,least,heavy", [
    (2048, 0.003, 4096, 1024),      # as shipped
    (2048, 0.003, 10, 2),           # two groups are bracketed, the others not
    (8, 0.0, 10, 1024),             # coarse sketches without a margin: positions are missed
])
def test_brackets_and_missed_positions(spark, monkeypatch, k, margin, least, heavy):
    import random
    for name, value in (("K", k), ("MARGIN", margin), ("LEAST", least), ("HEAVY", heavy)):
        monkeypatch.setattr(quantiles, name, value)
    rng = random.Random(k + least)
    odd = [float("nan"), float("inf"), float("-inf"), None, 0.0]
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]),
             rng.choice(odd) if rng.random() < 0.1 else round(rng.gauss(0, 100), 2)) for _ in range(9000)]
    rows += [("nan", float("nan"))] * 40 + [("same", 5.0)] * 50 + [("none", None)] * 3 + [("one", 1.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    box = quantiles.rank_select(df, ["g"], "v", quantiles.box_positions())
    got = {r.g: tuple(map(str, (r.lower, r.q1, r.median, r.q3, r.upper))) for r in box.collect()}
    assert got == positions_of(rows, 0, PICK)
    whole = quantiles.rank_select(df, [], "v", quantiles.box_positions()).collect()
    assert len(whole) == 1
    assert tuple(map(str, whole[0][1:])) == positions_of([(0, v) for _, v in rows], 0, PICK)[0]


def test_missed_positions(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "K", 8)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    out = grouped_quantiles(rows, ["l_returnflag"], "l_extendedprice", {"m": 0.5})
    got = {r.l_returnflag: r.m for r in out.collect()}
    want = rows.groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("m")).collect()
    assert got == {r.l_returnflag: pytest.approx(r.m) for r in want}


def test_other_types(spark):
    df = spark.sql("""SELECT id % 3 AS g, id * 7 % 9001 AS i, CAST(id * 7 % 9001 AS DECIMAL(20,3)) AS d,
        DATE'2020-01-01' + CAST(id * 7 % 9001 AS INT) AS t, TIMESTAMP_MICROS(id * 7 % 9001) AS u,
        LPAD(CAST(id * 7 % 9001 AS STRING), 5, '0') AS s, id * 7 % 9001 + 9007199254740993 AS l FROM range(15000)""")
    for c in "idtusl":
        box = quantiles.rank_select(df, ["g"], c, quantiles.box_positions())
        got = {r.g: tuple(r)[2:] for r in box.collect()}
        values = {}
        for r in df.select("g", c).collect():
            values.setdefault(r[0], []).append(r[1])
        assert got == {g: tuple(sorted(v)[f(len(v))] for f in PICK) for g, v in values.items()}, c


def test_no_values(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert quantiles.rank_select(df, ["g"], "v", quantiles.box_positions()).collect() == []
    assert quantiles.rank_select(df, [], "v", quantiles.box_positions()).collect() == []
