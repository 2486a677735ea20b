from pyspark.sql import functions as F

from lexforge.plans.ranking import numbered


def test_numbers_run_through_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 1, (F.col("id") % 50).cast("string")).alias("g"), ((F.col("id") * 7919) % 5003).alias("k"))
    got = [tuple(r) for r in numbered(df, ["g"], "k", "rn").select("g", "k", "rn").collect()]
    want = {}
    for g, k in sorted(((g, k) for g, k, _ in got), key=lambda x: (x[0] or '', x[1])):
        want.setdefault(g, []).append(k)
    assert len(got) == 5000 and all(want[g][rn - 1] == k for g, k, rn in got)
    assert numbered(df.limit(0), ["g"], "k", "rn").count() == 0
