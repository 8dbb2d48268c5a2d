import random

import pytest

from clearfield.llm.common import Durable, components


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    r = random.Random(kind)
    pairs = {
        "random": [(r.randrange(200), r.randrange(200)) for _ in range(120)],
        "path": [(k, k + 1) for k in range(60)],
        "star": [(50, k) for k in range(120) if k != 50],
        "none": [],
    }[kind]
    rows = [(a, b) for a, b in pairs] + [(None, 3), (7000, 7000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(rows, "a long, b long"), Durable(spark)).collect()}
    assert got == brute([(a, b) for a, b in pairs if a != b])
