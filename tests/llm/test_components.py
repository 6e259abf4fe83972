"""Connected components against a plain union-find."""

from __future__ import annotations

import random

import pytest

from tapeline.llm.near_dedup import components


def plain(edges):
    above: dict[int, int] = {}

    def head(x):
        above.setdefault(x, x)
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = head(a), head(b)
        above[max(x, y)] = min(x, y)
    return {x: head(x) for x in above}


def cases():
    rng = random.Random(1)
    yield [(i, i + 1) for i in range(60)]
    yield [(99, i) for i in range(40)] * 2
    yield [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b]
    walk = rng.sample(range(200), 120)
    yield list(zip(walk, walk[1:]))


@pytest.mark.parametrize("edges", cases())
def test_components_match_union_find(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.text_id for r in found}) and {r.text_id: r.label for r in found} == plain(edges)


def test_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert components(none).count() == 0
