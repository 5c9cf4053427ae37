import heapq
import random

import numpy as np
import pytest

from meshweave.operators import kernels


def plain(n, edges, directed, sources):
    """Least (distance, hops, predecessor) by node, one label at a time."""
    best, heap = {}, [(0.0, 0, -1, s) for s in sources]
    while heap:
        *label, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = tuple(label)
        for a, b, w in edges:
            for x, y in ((a, b),) if directed else ((a, b), (b, a)):
                if x == v and y not in best:
                    heapq.heappush(heap, (label[0] + w, label[1] + 1, v, y))
    return best


@pytest.mark.parametrize("most", [30, 0])
def test_least_labels(most):
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n), rng.choice([1.0, 1.0, 2.0, 0.5, 3.25])) for _ in range(rng.randrange(14))]
        src, dst, w = (np.array([e[k] for e in edges], t) for k, t in ((0, np.int64), (1, np.int64), (2, float)))
        directed, sources = rng.random() < 0.5, [rng.randrange(n) for _ in range(rng.randrange(1, 3))]
        want = plain(n, edges, directed, sources)
        d, hops, pred = kernels.distances(n, src, dst, w, directed, sources, None, most)
        assert {v: (d[v], hops[v], pred[v]) for v in range(n) if np.isfinite(d[v])} == want
        cut, _, _ = kernels.distances(n, src, dst, w, directed, sources, 2.5, most)
        assert {v for v in range(n) if np.isfinite(cut[v])} == {v for v in want if want[v][0] <= 2.5}
