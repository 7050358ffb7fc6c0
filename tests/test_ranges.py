import random

from pyspark.sql import functions as F

from quarry.functions import ranges


def test_positions_of_hot_null_and_tied_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(200)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, id long").repartition(5)
    got = ranges.positions(ranges.ranged(df, ["g", "o", "id"]), ["g"], "pos").collect()
    assert len({r["_part"] for r in got if r["g"] == "a"}) > 1  # the hot group lies in several ranges
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    for g in ("a", "b", None):
        want = [r[2] for r in sorted((r for r in rows if r[0] == g), key=key)]
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["pos"])
        assert [r["id"] for r in own] == want and [r["pos"] for r in own] == list(range(len(own)))


def test_positions_without_groups_and_of_an_empty_table(spark):
    df = spark.range(100).withColumn("k", -F.col("id"))
    got = {r["id"]: r["pos"] for r in ranges.positions(ranges.ranged(df, ["k"]), [], "pos", small=True).collect()}
    assert got == {i: 99 - i for i in range(100)}
    assert ranges.positions(ranges.ranged(df.limit(0), ["k"]), ["id"], "pos").count() == 0
