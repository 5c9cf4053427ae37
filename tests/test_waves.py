import random

import pytest

from meshweave import Graph
from meshweave.operators import graph as graph_module


def rows(df):
    return sorted(tuple(r) for r in df.collect())


class Counted:
    """Jobs and written rows of what runs inside."""

    def __init__(self, spark):
        self.spark, self.sc = spark, spark.sparkContext

    def _stages(self):
        self.sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        gate = self.sc._gateway
        found = self.sc._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), None)
        return sum(found.apply(k).outputRecords() for k in range(found.size()))

    def __enter__(self):
        self.before, self.group = self._stages(), f"counted-{random.random()}"
        self.sc.setJobGroup(self.group, "")
        return self

    def __exit__(self, *_):
        self.written = self._stages() - self.before
        self.jobs = len(self.sc.statusTracker().getJobIdsForGroup(self.group))


def test_distances_are_not_written_anew(spark, monkeypatch):
    pairs = [(0, k) for k in range(1, 301)] + [(300 + k, 301 + k) for k in range(8)]
    g = Graph.from_lists(spark, range(309), pairs, weights=[1.0] * len(pairs))
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    with Counted(spark) as c:
        out = rows(g.shortest_path_lengths(0))
    assert len(out) == 309 and out[-1] == (308, 9.0)
    assert c.written <= 5 * len(pairs)


@pytest.mark.parametrize("directed", [False, True])
def test_distances_and_paths_of_both_tiers(spark, monkeypatch, directed):
    rng = random.Random(5)
    pairs = [(rng.randrange(25), rng.randrange(25)) for _ in range(60)]
    g = Graph.from_lists(spark, range(27), pairs, weights=[rng.choice([0.0, 1.0, 1.0, 2.0, 0.5, 9.0]) for _ in pairs], directed=directed)
    calls = [lambda: g.multi_source_shortest_path_lengths([0, 26, 7]), lambda: g.shortest_path_lengths(1, cutoff=2.5), lambda: g.shortest_path(0, 9), lambda: g.shortest_path(0, 25)]
    want = [rows(f()) for f in calls]
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 0)
    assert [rows(f()) for f in calls] == want


def test_long_order_takes_few_jobs(spark, monkeypatch):
    g = Graph.from_lists(spark, range(30), [(k, k + 1) for k in range(24)] + [(0, 29), (25, 24)], directed=True)
    want = rows(g.dag_longest_path())
    assert len(want) == 25
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", 20)
    with Counted(spark) as c:
        assert rows(g.dag_longest_path()) == want
    assert c.jobs < 100


@pytest.mark.parametrize("most", [0, 40])
def test_order_of_both_tiers(spark, monkeypatch, most):
    rng = random.Random(8)
    pairs = [tuple(sorted(rng.sample(range(16), 2))) for _ in range(50)]
    g = Graph.from_lists(spark, range(18), pairs, weights=[rng.choice([1.0, 2.0, 5.0, -3.0]) for _ in pairs], directed=True)
    want = rows(g.topological_sort()), rows(g.dag_longest_path())
    monkeypatch.setattr(graph_module, "KERNEL_EDGES", most)
    assert (rows(g.topological_sort()), rows(g.dag_longest_path())) == want
    back = g.with_edges([(15, 0)])
    for call in (back.topological_sort, back.dag_longest_path):
        with pytest.raises(ValueError, match="cycle"):
            call()
