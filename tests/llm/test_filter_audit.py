"""The audit of filters against a plain walk through every order."""

import itertools
import re

from ledgerloom.llm import filter_audit

from .util import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def plain(rows, labels):
    """rows (doc_id, text, lang); labels {doc_id: (good, toxic)}."""
    judged = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows),
        }
        judged.append((lang or "", {f for f, x in fails.items() if x}, *labels.get(doc_id, (False, False))))
    out = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                shapley[f] += len(gone)
                fails = sum(f in j[1] for j in mine)
                only = sum(j[1] == {f} for j in mine)
                found.append((part, "".join(order), step, len(left), len(gone), fails - len(gone), only, sum(j[2] for j in gone), sum(j[3] for j in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in found]
    return sorted(out)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, part string")


def audited(spark, rows, labels):
    made = spark.createDataFrame([(i, t, x, "c", "n") for i, t, x in rows], "doc_id long, text string, lang string, filter string, removed string")
    found = filter_audit.interactions(made, labelled(spark, labels))
    return sorted(tuple(r[c] for c in NAMES) for r in found.collect())


def test_odd_rows_equal_a_plain_walk(spark):
    many = " ".join(f"w{i}" for i in range(300))
    rows = [(i, t, ("en", None, "", "de")[n % 4]) for n, (i, t) in enumerate(ODD)]
    rows += [(20, many, "en"), (21, many, "de"), (22, many, "de"), (23, many + " $", "en"), (24, "a " * 400 + "B#", "en"), (25, many.upper(), "en"), (None, many, "en")]
    labels = [(20, 1, 0, "x"), (20, None, 1, "x"), (21, 1, None, "x"), (22, 0, 0, "x"), (24, None, 1, "x"), (None, 1, 1, "x"), (99, 1, 1, "x")]
    known: dict = {}
    for i, q, t, _ in labels:
        a = known.get(i, (False, False))
        if i is not None:
            known[i] = (a[0] or q == 1, a[1] or t == 1)
    got = audited(spark, rows, labels)
    assert got == plain(rows, known)
    assert len(got) == 600 * len({x or "" for _, _, x in rows})


def test_empty_table_has_no_parts(spark):
    assert audited(spark, [], [(1, 1, 1, "x")]) == []


def test_states_are_executed_once(spark, monkeypatch):
    made = spark.createDataFrame([(1, "a", "en"), (2, "b $", "de")], "doc_id long, text string, lang string")
    persisted = []
    kind = type(made)
    real = kind.persist
    monkeypatch.setattr(kind, "persist", lambda self, *a: persisted.append(1) or real(self, *a))
    filter_audit.interactions(made, labelled(spark, [])).collect()
    assert len(persisted) == 31
