import random

import numpy as np
import pytest

from meshweave import Graph
from meshweave.operators import graph as graph_module
from meshweave.operators import kernels, labels, spread


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("most", [0, 30])
def test_labels_with_hot_keys(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(labels, "HOT_ROWS", 3)
    rng = random.Random(2)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(k, k + 1) for k in range(70, 90)] + [(5, 5), (95, 95)]
    spark.createDataFrame(pairs, "src long, dst long").write.parquet(str(tmp_path / "e"))
    got = dict(rows(labels.label_components(spark.read.parquet(str(tmp_path / "e")), most)))
    want = kernels.union_labels(96, *(np.array([p[k] for p in pairs]) for k in (0, 1)))
    assert [got.get(v, v) for v in range(96)] == want.tolist()
    assert all(v != c for v, c in got.items())


def test_no_join_takes_a_whole_block(spark, monkeypatch):
    # one block of all edges: its rows may not meet in one task to get its name
    pairs = [(k, (k + 1) % 7) for k in range(7)]
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    monkeypatch.setattr(graph_module, "COMPONENT_EDGES", 5)
    monkeypatch.setattr(labels, "HOT_ROWS", 3)
    monkeypatch.setattr(spread, "label_components", lambda edges: labels.label_components(edges, 0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what is asked for
    try:
        out = Graph.from_lists(spark, range(7), pairs).blocks()
        assert rows(out) == [(0, k) for k in range(7)]
        assert "BroadcastExchange" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
