from pyspark.sql import functions as F

from dashframe.llm.common import lowest


def test_the_bound_keeps_the_smallest_draws(spark):
    draw = F.xxhash64("id")
    rows = spark.range(20000)
    want = [r.id for r in rows.orderBy(draw, "id").limit(50).collect()]
    few = lowest(rows, draw, 50)
    assert [r.id for r in few.orderBy(draw, "id").limit(50).collect()] == want
    assert 50 <= few.count() < 1000


def test_rows_that_share_a_draw_raise_the_bound(spark):
    # All but 40 rows have one (NULL) id, whose draw may lie beyond any bound.
    rows = spark.range(3000).select(F.when(F.col("id") < 40, F.col("id")).alias("id"))
    for n in (1, 30, 41, 500, 5000):
        assert lowest(rows, F.xxhash64("id"), n).count() >= min(n, 3000)
    assert lowest(rows.limit(0), F.xxhash64("id"), 5).count() == 0
