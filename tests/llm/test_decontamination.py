import hashlib
import random
import re

import pytest

from ledgerloom.llm import decontamination as d

from .util import ODD, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        x = words(item)
        n = min(13, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(item_id)
    sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("limit", [d.AUTOMATON_BYTES, 200])
def test_equals_brute_force(spark, limit):
    rng = random.Random(2)
    vocabulary = ["Ab", "c1", "é", "d", "E", "ff"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 5, 13, 20))))) for i in range(12)] + [(20, None), (None, "ab c1"), (3, "d-d-d")]
    texts = [(i, rng.choice((" ", ", ", "--")).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)]
    texts += [(100, "zz " * 300 + (items[4][1] or "x"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(docs(spark, texts), bench, limit=limit).collect()
    known = [x for x in items if x[0] is not None]
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(r.text, known), r.text
        assert sum(len(words(r.text[s.start : s.end])) for s in r.spans) == r.n_hit


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "A b c d e")], "item_id long, text string")
    rows = d.contamination(docs(spark, ODD), bench, carry=True)
    found = rows.collect()
    assert len(found) == len(ODD) and rows.select("row.*").columns == docs(spark, []).columns
    assert {r.doc_id: r.n_hit for r in found}[6] == 5
    assert d.contamination(docs(spark, []), bench).collect() == []
    assert all(not r.contaminated for r in d.contamination(docs(spark, ODD), bench.limit(0)).collect())


def test_long_texts_come_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(d, "CHUNK", 40)
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.choice((3, 12, 13, 14, 60))))) for i in range(10)]
    automaton = d.Automaton([(i, p) for i, t in items for p in d.parts_of(t.encode(), 13)])
    for _ in range(60):
        text = " ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(30)) + " " + rng.choice(items)[1][rng.randrange(9) :] + " x" * 30
        n, spans, found = automaton.scan(text.encode())
        want = brute(text, items)
        assert (n, sum(b - a for a, b in spans), len(found)) == want[:3]


def test_every_window_holds_a_block():
    for size in range(1, 30):
        words = [f"w{i}" for i in range(40)]
        automaton = d.Automaton([(1, " ".join(words).encode())], size)
        for at in range(len(words) - size + 1):
            assert automaton.scan(" ".join(["zz", *words[at : at + size], "zz"]).encode()) == (size + 2, [(1, size + 1)], {1})
            if size > 1:
                assert automaton.scan(" ".join(["zz", *words[at : at + size - 1], "zz"]).encode())[1:] == ([], set())
