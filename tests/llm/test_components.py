import random

import pytest

from sinew.llm import components as module
from sinew.llm.components import components


@pytest.fixture
def written(monkeypatch):
    """The plans of the tables written between rounds."""
    plans, bare = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or bare(df, name))
    return plans


def smallest_reachable(links):
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_no_query_of_a_round_has_a_large_plan(llm, written, kind):
    """Chains, cycles, a node with many links and random ones: right roots, and at most five exchanges a query, so the driver holds no large plan."""
    rng = random.Random(3)
    chain = rng.sample(range(1000, 2000), 60)
    links = [*zip(chain, chain[1:], strict=False), *((3000 + k, 3000 + (k + 1) % 9) for k in range(9)), *((5000, 5000 + k) for k in range(200))]
    links += [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(7000, 7000), (1001, 1001)]
    links = [link[:: rng.choice([1, -1])] for link in links * 2]
    if kind == "string":
        links = [(f"n{a}", f"n{b}") for a, b in links]
    found = components(llm.createDataFrame(links, f"a {kind}, b {kind}")).collect()
    assert sorted(map(tuple, found)) == sorted(smallest_reachable(links).items())
    assert len(written) > 4 and max(plan.count("Exchange") for plan in written) <= 5


def test_links_to_roots_take_no_round(llm, written):
    """Pairs and stars, either way round, are their own result; a table without links is too."""
    found = components(llm.createDataFrame([(1, 2), (2, 1), (4, 3), (3, 5), (6, 3), (8, 8), (None, 9), (9, None)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(2, 1), (4, 3), (5, 3), (6, 3)] and len(written) == 1
    assert not components(llm.createDataFrame([(8, 8)], "a long, b long")).collect() and len(written) == 2
