"""Property tests: Fisher p in (0, 1] and symmetric under transposition;
split class counts are ceil(p * n); flags are 0/1."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from homerange.operators import model, stats

cell = st.integers(min_value=0, max_value=40)
CONF = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**CONF)
@given(st.lists(st.tuples(cell, cell, cell, cell), min_size=1, max_size=4))
def test_fisher_bounds_and_transpose(spark, tables):
    rows = [(i, a, b, c, d) for i, (a, b, c, d) in enumerate(tables)]
    t = spark.createDataFrame(rows, "g long, tl long, tr long, bl long, br long")
    tt = spark.createDataFrame([(i, a, c, b, d) for i, a, b, c, d in rows], "g long, tl long, tr long, bl long, br long")
    p = {r.g: r.p_value for r in stats.fisher_exact(t, by=["g"]).collect()}
    q = {r.g: r.p_value for r in stats.fisher_exact(tt, by=["g"]).collect()}
    for g in p:
        assert 0.0 < p[g] <= 1.0 + 1e-12
        assert math.isclose(p[g], q[g], rel_tol=1e-9, abs_tol=1e-12)


@settings(**CONF)
@given(st.integers(1, 60), st.integers(1, 60), st.sampled_from([0.3, 0.5, 0.6, 0.75]), st.integers(0, 5000))
def test_split_counts(spark, ny, nn, p, seed):
    df = spark.createDataFrame([(i, "Y" if i < ny else "N") for i in range(ny + nn)], "business_id long, Highly_Liked string")
    s = model.stratified_split(df, p=p, seed=seed)
    got = {r.Highly_Liked: r["count"] for r in s.filter("split = 'train'").groupBy("Highly_Liked").count().collect()}
    from decimal import Decimal

    want_y = math.ceil(Decimal(str(p)) * ny)
    want_n = math.ceil(Decimal(str(p)) * nn)
    assert got.get("Y", 0) == want_y and got.get("N", 0) == want_n
