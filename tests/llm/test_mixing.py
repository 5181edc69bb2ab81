"""Mixing against plain arithmetic, and the cube method's own promises."""

import collections
import re

import numpy as np
import pytest

from ledgerloom.llm import mixing, queries

from .util import ODD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > most * sizes[s]}
        if not above:
            return {s: share.get(s, most * sizes[s]) for s in order}
        capped |= above


def source_sizes(rows):
    sizes: dict = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    return sizes


def judged(found, rows):
    """Checks what every mix must hold; returns the words taken, by target."""
    sizes = source_sizes(rows)
    targets = plain_targets(sizes)
    by_row = collections.Counter((i, len(WORD.findall(t or "")), sizes[s], round(targets[s], 6)) for i, t, s in rows)
    assert by_row == collections.Counter((x.doc_id, x["size"], x.source_size, round(x.target, 6)) for x in found)
    words: dict = collections.Counter()
    for x in found:
        rate = x.target / x.source_size if x.source_size else 0
        assert x.taken == x.copies * x["size"] and x.copies <= 3
        assert int(rate + 1e-9) <= x.copies <= int(rate + 1e-9) + (rate % 1 > 1e-9)
        words[round(x.target, 6), x.source_size] += x.taken
    return words


def test_query_takes_what_targets_say(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    found = queries.QUERIES["op11_cube_mixing"](spark, sf).collect()
    assert len(found) == len(rows)
    for (target, size), taken in judged(found, rows).items():
        assert abs(taken - target) <= max(0.02 * target, 1), (target, size, taken)


def test_reruns_and_other_layouts_agree(spark):
    table = docs(spark, [(i, "w " * (1 + i * i % 53), f"s{i % 4}") for i in range(200)])
    once, again = (sorted(map(tuple, mixing.mix(t).collect())) for t in (table, table.repartition(7, "n_chars")))
    assert once == again
    assert once != sorted(map(tuple, mixing.mix(table, seed=1).collect()))


def test_blocks_fly_again_until_one_is_left(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, " ".join(["w"] * (1 + i * i % 97)), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    found = mixing.mix(docs(spark, rows)).collect()
    for (target, _), taken in judged(found, rows).items():
        assert abs(taken - target) <= 10
    for (target, size), number in collections.Counter((x.target, x.source_size) for x in found).items():
        copies = sum(x.copies for x in found if (x.target, x.source_size) == (target, size))
        assert abs(copies - number * target / size) <= 4


def test_odd_rows(spark):
    rows = [(i, t, (None, "", "s", "\U0001f642", "￿")[n % 5]) for n, (i, t) in enumerate(ODD)]
    judged(mixing.mix(docs(spark, rows)).collect(), rows)
    only_blank = [(1, None, "a"), (2, " ", None)]
    assert [x.taken for x in mixing.mix(docs(spark, only_blank)).collect()] == [0, 0]
    assert mixing.mix(docs(spark, [])).collect() == []


def test_a_row_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "REPEATS", 64)
    rows = [(7, "a b c", "x")] * 1000 + [(None, "one", "x")] * 300 + [(i, "d e f g", "y") for i in range(200)]
    words = judged(mixing.mix(docs(spark, rows)).collect(), rows)
    for (target, _), taken in words.items():
        assert abs(taken - target) <= 4


def test_no_source_above_three_times_its_size(spark):
    rows = [(1, "a " * 50_000, "a"), *((i, "b c", "b") for i in range(2, 60)), (99, "d", "c")]
    found = mixing.mix(docs(spark, rows)).collect()
    judged(found, rows)
    assert {x.doc_id: x.taken for x in found}[99] == 3 and all(x.copies == 3 for x in found if x.doc_id not in (1,))


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_both_totals(seed):
    rng = np.random.default_rng(seed)
    sizes, chances = rng.integers(0, 500, 400).astype(float), rng.uniform(0, 1, 400)
    moved = mixing.flight(sizes, chances, rng.uniform(0, 1, 400))
    assert ((moved == 0) | (moved == 1)).sum() >= 398 and moved.min() >= 0 and moved.max() <= 1
    assert abs(moved.sum() - chances.sum()) < 1e-6 and abs((moved * sizes).sum() - (chances * sizes).sum()) < 1e-4


def test_flight_keeps_each_chance_on_average():
    rng = np.random.default_rng(3)
    sizes, chances = rng.integers(1, 50, 30).astype(float), rng.uniform(0.1, 0.9, 30)
    mean = np.mean([mixing.flight(sizes, chances, rng.uniform(0, 1, 30)) for _ in range(4000)], axis=0)
    assert np.abs(mean - chances).max() < 0.04


def test_landing_and_ladder():
    sizes = np.array([800.0, 700, 390, 210, 100, 52, 24, 13, 6, 3, 2, 1])
    assert list(mixing.ladder(sizes, 4)) == [0, 2, 3, 4]
    chances = np.full(12, 0.37)
    out = mixing.landing(sizes, chances)
    assert abs(out @ sizes - 0.37 * sizes.sum()) < 8 and abs(out.sum() - 12 * 0.37) < 2
