"""Cells of the embedding search at sizes that the tables do not reach."""

import resource

import numpy as np
import pyarrow as pa

from homerange.llm import embedding_dedup as dedup


def test_a_thousand_wide_centres_stay_small():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(1024, 768))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    unit = rng.normal(size=(3000, 768))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[:1000] = centres[:1000]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    home, visited = dedup.Cells(centres, 0.95).visits(unit)
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert (home[:1000] == np.arange(1000)).all() and all(h in v for h, v in zip(home, visited))
    assert grown < 500
    # the plain margin of a few rows
    for r in (0, 5, 2500):
        near = centres @ unit[r]
        between = np.linalg.norm(centres - centres[home[r]], axis=1)
        plain = np.flatnonzero(near[home[r]] - near <= 0.5 * np.sqrt(2 - 2 * 0.95) * between)
        assert set(plain) <= set(visited[r].tolist())


def test_many_near_copies_in_one_block():
    rng = np.random.default_rng(2)
    n, width = 6000, 32
    rows = np.ones(width) + 0.01 * rng.normal(size=(n, width))
    group = pa.table(
        {
            "cell": pa.array(np.zeros(n, np.int32)), "i": pa.array(np.zeros(n, np.int32)), "j": pa.array(np.zeros(n, np.int32)),
            "side": pa.array(np.zeros(n, np.int32)), "node": pa.array(np.arange(n)), "home": pa.array(np.zeros(n, np.int32)),
            "weight": pa.array(np.ones(n, np.int64)), "vector": pa.array(list(rows)),
            "visits": pa.array([[0]] * n, type=pa.list_(pa.int32())),
        }
    )
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = dedup._meet(group, width, 0.95).to_pydict()
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert got["links"] == [n - 1] * n and set(got["root"]) == {0}
    assert grown < 900
