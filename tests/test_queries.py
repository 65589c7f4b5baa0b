"""Every query against its SQL form on the smallest tables."""

import compare
import pytest

from lattica import queries as q


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    ok, why = compare.compare(spark, duck, q.QUERIES[name], q.ORACLE_SQL.get(name), sf_dir)
    assert ok, why


def test_golden_values(spark, sf_dir):
    vi = q.QUERIES["variation_of_information"](spark, sf_dir).first()
    assert (vi.vi_merge, vi.vi_split) == (0.783604, 2.162365)
    rand = q.QUERIES["rand_error"](spark, sf_dir).first()
    assert (rand.rand_merge, rand.rand_split) == (0.012083, 0.044201)
    assert q.QUERIES["adapted_rand"](spark, sf_dir).first().are == 0.643432
    assert q.QUERIES["adjacency"](spark, sf_dir).count() == 104


def test_no_query_collects_or_joins_without_a_key(spark, sf_dir):
    """Plans of joins between voxels are equi-joins."""
    for name in ("face_pairs", "endpoint_cone", "dilate_gold", "feature_cubes"):
        plan = q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan, name
