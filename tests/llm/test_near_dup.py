import itertools
import random
import re

import numpy as np
import pytest

from ledgerloom.llm import near_dup
from ledgerloom.llm.components import connected_components, merged_components
from ledgerloom.llm.scratch import Scratch

from .util import ODD, docs


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, p):
    """doc_id to (set size, smallest reachable id)."""
    sets = {i: shingles(t, k) for i, t in rows}
    low = {i: i for i in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= p * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(seed, n, words, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("block", "reband"), [(near_dup.BLOCK_ROWS, near_dup.REBAND_ROWS), (7, near_dup.REBAND_ROWS), (7, 1)])
def test_equals_brute_force_on_chained_families(spark, monkeypatch, block, reband):
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dup, "REBAND_ROWS", reband)
    monkeypatch.setattr(near_dup, "BLOCK_HASHES", 512)
    texts = family(1, 60, 120, 14) + family(2, 25, 1300, 160) + family(3, 10, 8, 3) + ["", None, "one", "one", "ONE"]
    rows = list(enumerate(texts, start=10))
    found = near_dup.near_duplicates(docs(spark, rows), k=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_documents_that_share_only_a_crowded_key_are_linked(spark, monkeypatch):
    # one band, the same for all: no second key splits it
    monkeypatch.setattr(near_dup, "_bands", lambda samples, full, kind: [np.array([7], dtype=np.int64)] * len(samples))
    monkeypatch.setattr(near_dup, "REBAND_ROWS", 1)
    texts = [t for seed in range(11, 17) for t in family(seed, 4, 80, 3)]
    rows = list(enumerate(texts, start=1))
    found = near_dup.near_duplicates(docs(spark, rows), k=2).collect()
    want = brute(rows, 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) < len(rows)


def test_odd_rows(spark):
    found = near_dup.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2] == by[3] == [(0, by[1][0][1], True)] or all(by[i] == [(0, i, True)] for i in (1, 2, 3))
    assert by[6] == [(8, 6, True)] * 2 and by[7] == [(8, 6, False)]
    assert by[None] == [(8, None, True)]
    left = near_dup.one_of_each(docs(spark, ODD))
    assert left.columns == docs(spark, ODD).columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert near_dup.near_duplicates(docs(spark, [])).collect() == []
    assert near_dup.one_of_each(docs(spark, [])).collect() == []


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, size=(400, near_dup.SAMPLES), dtype=np.uint64)
    b = a.copy()
    differ = rng.random(a.shape) < 0.1
    b[differ] = rng.integers(0, 2**63, size=int(differ.sum()), dtype=np.uint64)
    full = np.ones(a.shape, dtype=bool)
    sides = [np.frombuffer(b"".join(near_dup._odd(x, full)), dtype=np.uint8).reshape(len(x), -1) for x in (a, b)]
    error = near_dup.odd_similarity(*sides) - (a == b).mean(axis=1)
    assert abs(error.mean()) < 0.005 and error.std() < 0.02
    assert near_dup.margin(0.8) < 0.7


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(1000, 1000 + i) for i in range(1, 200)]
    low = {x: x for e in edges for x in e}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    frame = lambda some: spark.createDataFrame([*some, (None, 3), (2, 2)], "a long, b long")
    found = connected_components(frame(edges), Scratch(spark, "t"))
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    # the same in two parts, the second taken into the components of the first; a third brings nothing new
    parts = merged_components(connected_components(frame(edges[::2]), Scratch(spark, "t")), frame(edges[1::2]), Scratch(spark, "t"), "m")
    for some in (found, parts, merged_components(parts, frame(edges[:50]), Scratch(spark, "t"), "m")):
        rows = some.collect()
        got = {r.node: r.root for r in rows}
        assert {x: got.get(x, x) for x in want} == want and len(got) == len(rows)
