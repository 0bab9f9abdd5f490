import random

import numpy as np
import pytest

from auditloom.operators import closure, dependence


def needed(edges, sources):
    """The rule of dependence, source by source, of edges (src, dst) in order."""
    out = set()
    for s in sources:
        seen, waiting = {s}, [s]
        while waiting:
            x = waiting.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    waiting.append(b)
        best = {}
        for k, (a, b) in enumerate(edges):
            if a in seen and b != s:
                best.setdefault(b, k)
        out |= set(best.values())
    return out


@pytest.mark.parametrize("most, marked", [(32, 1 << 28), (1, 1 << 28), (2, 1)])
def test_sets_and_tokens(monkeypatch, most, marked):
    """Small sets are tokens too, and tokens' bits are forgotten at once, so that every branch is reached."""
    monkeypatch.setattr(dependence, "MOST", most)
    monkeypatch.setattr(dependence, "MARKED", marked)
    rng = random.Random(7)
    for _ in range(300):
        top = rng.randint(3, 24)
        edges = list(dict.fromkeys(tuple(rng.sample(range(top), 2)) if rng.random() < 0.3 else tuple(sorted(rng.sample(range(top), 2))) for _ in range(rng.randint(2, 3 * top))))
        rng.shuffle(edges)
        src, dst = (np.array(x) for x in zip(*edges, strict=True))
        nodes = {x for e in edges for x in e}
        known = dependence.components(top, src, dst)
        back = [(b, a) for a, b in edges]
        assert set(dependence.needed(top, src, dst, False).tolist()) == needed(edges, nodes - set(dst.tolist()))
        assert set(dependence.needed(top, src, dst, True, *known).tolist()) == needed(edges, nodes)
        assert set(dependence.needed(top, dst, src, True, *known, backward=True).tolist()) == needed(back, nodes)


def crossing(spark, size):
    """Sources that all reach as many sinks by one node, and each sink by a second, later edge from the first source."""
    rows = spark.range(size)
    into = rows.selectExpr("0L AS epoch_id", "id AS event_id", "concat('a', id) AS src", "'hub' AS dst", "id AS t_s")
    out = rows.selectExpr("0L AS epoch_id", f"id + {size} AS event_id", "'hub' AS src", "concat('b', id) AS dst", f"id + {size} AS t_s")
    late = rows.selectExpr("0L AS epoch_id", f"id + 2 * {size} AS event_id", "'a0' AS src", "concat('b', id) AS dst", f"id + 2 * {size} AS t_s")
    return into.unionByName(out).unionByName(late)


def test_source_dependence_of_many_sources_and_sinks(spark):
    """1.6 thousand million pairs of a source and a node it reaches."""
    found = {r.event_id for r in closure.dpreserve_sd(crossing(spark, 40000)).collect()}
    assert found == set(range(80000, 120000))


def test_full_dependence_of_many_sources_and_sinks(spark):
    """Either way the same pairs, and each node with itself besides."""
    found = {r.event_id for r in closure.dpreserve_fd(crossing(spark, 40000)).collect()}
    assert found == set(range(80000, 120000))
