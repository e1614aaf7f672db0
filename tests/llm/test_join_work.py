"""How much work the n-gram join makes of little: rounds of components, leaves and their pairs."""

import random

import numpy as np
import pytest

from tessel.llm import components, ngram_join

from .test_operators import by_id, components_by_brute_force, near_copies, table


@pytest.mark.parametrize(("together", "rounds"), [(1 << 20, False), (10, True)])
def test_a_tasks_share_of_links_needs_no_rounds(spark, monkeypatch, together, rounds):
    written, staged = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, label: written.append(label) or staged(df, label))
    monkeypatch.setattr(components, "TOGETHER", together)
    order = list(range(60))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (7, 7), (71, 70), (71, 70)], "a long, b long").repartition(8)
    got = sorted(map(tuple, components.components(links, "chain").collect()))
    assert got == [(i, 0) for i in range(60)] + [(70, 70), (71, 70)]
    assert ("chain-parents" in written) == rounds
    assert components.components(links.limit(0), "none").collect() == []


def in_many_partitions(spark, monkeypatch, least):
    frame = type(spark.range(0))
    sort = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols: sort(self, max(n, least), *cols))


def test_leaves_are_filled_whatever_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f, 1000 * f + i, np.unique(rng.integers(0, 1 << 63, 12, np.uint64)).tobytes()) for f, n in ((1, 300), (2, 90)) for i in range(n)]
    points = spark.createDataFrame(rows, "family long, sid long, items binary")
    in_many_partitions(spark, monkeypatch, 100)
    got = ngram_join.leafed(points, None, 40, 4).collect()
    sids = [np.frombuffer(r["sids"], np.int64) for r in got]
    assert len(got) <= 2 * (8 + 3) and max(map(len, sids)) <= 50
    assert sorted(np.concatenate(sids).tolist()) == sorted(r[1] for r in rows)
    items = {r[1]: r[2] for r in rows}
    for r, mine in zip(got, sids, strict=True):
        assert r["leaf"] == mine[0] and {s // 1000 for s in mine} == {r["family"]}
        assert r["items"] == b"".join(items[s] for s in mine) and np.frombuffer(r["comps"], np.int64).tolist() == mine.tolist()


def test_filled_leaves_join_exactly(spark, monkeypatch):
    in_many_partitions(spark, monkeypatch, 40)
    texts = near_copies(240)
    got = by_id(ngram_join.jaccard_components(table(spark, texts), 2, 80, 8, 2))
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == components_by_brute_force(texts, 2, 80)
