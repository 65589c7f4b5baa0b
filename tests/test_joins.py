from collections import Counter

import pytest

from lattica.plans.joins import join_counted


@pytest.mark.parametrize("least", [1, 4, 1000])
def test_join_counted_is_a_join(spark, least):
    rows = [(i % 5 if i % 7 else None, i % 3, i) for i in range(60)] + [(9, 9, 9)]
    df = spark.createDataFrame(rows, "a int, b int, v int")
    counts = Counter((a, b) for a, b, _ in rows if a is not None and a != 9)
    table = spark.createDataFrame([(a, b, n, f"{a}{b}") for (a, b), n in counts.items()], "a int, b int, n int, name string")
    got = sorted((r.a, r.b, r.v, r.name) for r in join_counted(df, table, ["a", "b"], "n", 60, most=20, least=least).collect())
    assert got == sorted((a, b, v, f"{a}{b}") for a, b, v in rows if a is not None and a != 9)
    assert join_counted(df.limit(0), table, ["a", "b"], "n", 0).count() == 0
