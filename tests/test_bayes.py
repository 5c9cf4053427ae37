import math

import pytest

from meshweave import estimate_cpds, hill_climb_k2, k2_local_score


def frame(spark, data):
    return spark.createDataFrame(data, ", ".join(f"v{k} int" for k in range(len(data[0]))))


def test_k2_constant_and_unobserved(spark):
    assert k2_local_score(frame(spark, [(0, 0)] * 10), {"v0": 2, "v1": 2}, "v1", ["v0"]) == pytest.approx(-math.log(11))
    data = frame(spark, [(a, b) for a in (0, 1) for b in (0, 1)] * 5)
    got = k2_local_score(data, {"v0": 3, "v1": 2}, "v1", ["v0"])
    assert got == pytest.approx(2 * (2 * math.lgamma(6) - math.lgamma(12)))
    with pytest.raises(ValueError):
        k2_local_score(data, {"v0": 1, "v1": 2}, "v1", ["v0"])


def test_hill_climb(spark):
    copy = frame(spark, [(0, 0)] * 100 + [(1, 1)] * 100)
    assert {tuple(sorted(r)) for r in hill_climb_k2(copy, {"v0": 2, "v1": 2}).collect()} == {("v0", "v1")}
    assert hill_climb_k2(copy.limit(0), {"v0": 2, "v1": 2}).count() == 0


def test_cpds(spark):
    got = estimate_cpds(frame(spark, [(0, 0)] * 3 + [(0, 1)]), {"v0": 2, "v1": 2}, [("v0", "v1")])
    table = {tuple(r)[:3]: r[3] for r in got.collect()}
    assert table == pytest.approx({("v0", 0, 0): 5 / 6, ("v0", 0, 1): 1 / 6, ("v1", 0, 0): 4 / 6, ("v1", 0, 1): 2 / 6, ("v1", 1, 0): 0.5, ("v1", 1, 1): 0.5})
