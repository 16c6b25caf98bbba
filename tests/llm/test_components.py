import random

import pytest

from ledgerline.llm.components import components


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 1), (1, 2)], [(i, i + 1) for i in range(40)], [(100, i) for i in range(30)], [(random.Random(4).randrange(60), random.Random(i).randrange(60)) for i in range(40)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {tuple(r) for r in components(df).collect()} == brute(links)
