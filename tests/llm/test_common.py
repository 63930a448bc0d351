import random

import pytest

from quadloom.llm._common import components


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components_in_one_task_and_over_the_whole_table(spark, few):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(5), few=few).collect()
    assert {r["node"]: r["root"] for r in got} == {i: find(i) for i in root if find(i) != i}
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0
