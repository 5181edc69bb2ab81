from ledgerloom.llm import line_dedup, quality_rules
from ledgerloom.llm.scratch import Scratch

from .util import ODD, docs


def test_ledger_and_ablations(spark):
    rows = quality_rules.ledger(docs(spark, [*ODD, (20, "a b c d e\na b c d e\na b c d e"), (21, "# $ % & | < > * # $ words here"), (22, "x !!!! y !!!!")]))
    got = {r.doc_id: r for r in rows.collect()}
    assert (got[1].n_words, got[1].failed, got[2].failed, got[3].failed) == (0, 1, 1, 1)
    assert (got[20].n_repeat_words, got[20].n_dup_lines, got[20].n_lines) == (15, 2, 3)
    assert got[21].n_symbols == 10 and got[21].failed & 4
    assert got[9].word_chars == len("Ünïcode漢字\U0001f642\x00end")
    assert got[22].failed & 32 and got[5].n_words == 60_000
    assert all(r.kept_v1 == (not r.failed & 3) and r.kept_v2 == (not r.failed & 63) for r in quality_rules.policies(rows).collect())
    assert {r.rule: r.n_kept for r in quality_rules.ablations(rows, 1).collect()} == dict.fromkeys(quality_rules.BASE, sum(not r.failed & 3 for r in rows.collect()))
    table = {r.rule: r for r in quality_rules.ablations(rows).collect()}
    everything = rows.collect()
    whole = quality_rules.mask(quality_rules.POLICIES[quality_rules.LATEST])
    for rule in quality_rules.RULES:
        one = 1 << rule.bit
        assert table[rule.name].n_failed == sum(bool(r.failed & one) for r in everything)
        assert table[rule.name].n_kept_without == sum(not r.failed & whole & ~one for r in everything)
    assert quality_rules.ledger(docs(spark, [])).collect() == []
    assert {r.n_kept for r in quality_rules.ablations(quality_rules.ledger(docs(spark, []))).collect()} == {0}


def test_boilerplate_goes_and_copies_stay(spark):
    footer = "Subscribe to our newsletter today!"
    rows = [(i, f"A line that only document number {i} holds, and no other\n{footer}", f"site{i % 8}") for i in range(40)]
    rows += [(100 + i, "The very same document text on every site\nwith a second line of its own here", f"site{i % 8}") for i in range(40)]
    found = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs(spark, rows)).collect()}
    assert all(found[i].text == rows[i][1].split("\n")[0] and found[i].n_removed == 1 for i in range(40))
    assert all(found[100 + i].text == rows[40 + i][1] for i in range(40))


def test_near_threshold_lines_are_counted_exactly(spark):
    # five sites exactly, and four with as many documents
    rows = [(i, f"Words of their own in document {i} and more of them\nA footer on five different sites\n", f"s{i % 5}") for i in range(10)]
    rows += [(50 + i, f"Words of their own in document {50 + i} and more of them\nA footer on four different sites\n", f"s{i % 4}") for i in range(10)]
    found = {r.doc_id: r.n_removed for r in line_dedup.remove_boilerplate(docs(spark, rows)).collect()}
    assert all(found[i] == 1 for i in range(10)) and all(found[50 + i] == 0 for i in range(10))
    sketches = line_dedup.sketched(line_dedup.line_table(docs(spark, rows)), Scratch(spark, "t"), near=0.1).collect()
    assert [r.sure for r in sketches] == [False]


def test_odd_rows(spark):
    frame = docs(spark, [*ODD, (30, "x", None)])
    found = line_dedup.remove_boilerplate(frame)
    assert set(found.columns) == set(frame.columns)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(repr, ((r.doc_id, r.text) for r in frame.collect())))
    assert line_dedup.remove_boilerplate(docs(spark, [])).collect() == []


def test_repeated_rows_and_long_notices_change_nothing(spark):
    notice = "This notice stands on every page and is longer than all else that the page holds."
    rows = [(i, f"own words {i} of this page\n{notice}", f"site{i}") for i in range(40)]
    for some in (rows, rows * 3, [(i + 1000 * n, t, s) for n in range(3) for i, t, s in rows]):
        found = line_dedup.remove_boilerplate(docs(spark, some)).collect()
        assert len(found) == len(some) and all(r.n_removed == 1 and r.text == f"own words {r.doc_id % 1000} of this page" for r in found)


def test_pages_of_little_but_boilerplate(spark):
    parts = [f"Boilerplate number {n}, of which every page holds several, and so on" for n in range(4)]
    rows = [(i, "\n".join([*parts, f"own {i}"]), f"site{i % 7}") for i in range(21)]
    rows += [(50 + i, "\n".join(parts), f"site{i}") for i in range(3)]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_boilerplate(docs(spark, rows)).collect()}
    assert all(found[i] == (f"own {i}", 4) for i in range(21)) and all(found[50 + i] == ("", 4) for i in range(3))


def test_names_that_the_operator_uses(spark):
    frame = docs(spark, [(i, f"own {i}\nA footer on all of the sites", f"s{i % 9}") for i in range(18)])
    clashing = frame.selectExpr("*", "1 AS __cut", "2 AS t", "3 AS keys", "4 AS left", "5 AS __id", "6 AS k")
    found = line_dedup.remove_boilerplate(clashing)
    assert set(found.columns) == set(clashing.columns)
    assert {(r.n_removed, r["keys"], r["left"]) for r in found.collect()} == {(1, 3, 4)}
