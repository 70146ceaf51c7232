from __future__ import annotations

import random

import pytest

from granary.llm import _components
from granary.sources import stage_boundary


@pytest.mark.parametrize("few", [_components.FEW_LINKS, -1])
def test_few_links_need_no_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(_components, "FEW_LINKS", few)
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(150)] + [(900, 900)]
    parent = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = _components.components(stage_boundary(spark.createDataFrame(pairs, "a long, b long")))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in parent}
    assert ("Exchange" in got._jdf.queryExecution().executedPlan().toString()) == (few < 0)
