"""A-16 extended: per-column counts."""

from tessera.operators import profile as PR


def test_column_stats_exact_and_estimated(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "b")], "k long, `v x` string")
    for exact in (True, False):  # tiny inputs: the estimate is exact too
        got = {r.column_name: (r.rows, r.non_null, r.nulls, r.distinct_values)
               for r in PR.column_stats(df, exact=exact).collect()}
        assert got == {"k": (4, 3, 1, 2), "v x": (4, 3, 1, 2)}
