import itertools

import corpus_pipeline

from ledgerloom.llm import line_dedup

from .util import ODD, docs


def stage(spark, rows):
    """Texts by document after the pipeline's stage."""
    return {r.doc_id: r.text for r in corpus_pipeline.cut_boilerplate(spark, docs(spark, rows), "").collect()}


def words(seed, n):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_copies_veto_no_line(spark):
    footer = "Subscribe to our newsletter today!"
    rows = [(i, f"{words(i, 30)}\n{footer}", f"site{i % 6}") for i in range(12)]
    rows += [(100 + i, f"{words(1000, 30)}\n{words(1001, 20)}\n{footer}", f"site{i % 6}") for i in range(60)]
    found = stage(spark, rows)
    assert all(found[i] == words(i, 30) for i in range(12))
    assert all(found[100 + i] == f"{words(1000, 30)}\n{words(1001, 20)}" for i in range(60))


def test_copies_near_and_exact_keep_their_lines(spark):
    whole = [", ".join(words(2000 + 10 * n + m, 6) for m in range(10)) for n in range(4)]
    rows = [(i, "\n".join(whole), f"site{i % 8}") for i in range(40)]
    # near copies have words of their own in two places of the longest line
    rows += [(100 + i, "\n".join([whole[0].replace("w2001x3", f"own{i}").replace("w2007x3", f"more{i}{'y' * 20}"), *whole[1:]]), f"site{i % 8}") for i in range(20)]
    found = stage(spark, rows)
    assert all(found[i] == t for i, t, _ in rows)


def test_passage_longer_than_all_own_lines(spark):
    passage = ", ".join(words(5000 + n, 12) for n in range(5))
    rows = [(i, f"{words(i, 9)}\n{passage}\n{words(100 + i, 8)}", f"site{i % 20}") for i in range(100)]
    found = stage(spark, rows)
    assert all(found[i] == f"{words(i, 9)}\n{words(100 + i, 8)}" for i in range(100))


NOTICES = [f"{words(9000 + n, 30)}, {words(9100 + n, 30)}." for n in range(8)]


def test_notice_on_pages_of_one_template(spark):
    own = "Copyright 2024, All rights reserved by the owner of this site, web{}"
    found = stage(spark, [(i, f"{NOTICES[0]}\n{own.format(i)}", f"site{i}") for i in range(40)])
    assert all(found[i] == own.format(i) for i in range(40))


def test_pages_of_nothing_but_notices(spark):
    mixes = [m for m in itertools.combinations(range(8), 3)]
    found = stage(spark, [(i, "\n".join(NOTICES[n] for n in mixes[i]), f"site{i}") for i in range(40)])
    assert all(found[i] == "" for i in range(40))


def test_copies_with_notices_of_their_own_keep_their_lines(spark):
    whole = [words(7000 + n, 12) for n in range(6)]
    # each copy lacks a line, and stands on another site
    rows = [(i, "\n".join(x for n, x in enumerate(whole) if (n + i) % 6), f"site{i % 9}") for i in range(60)]
    found = stage(spark, [(i, f"{t}\n{words(i % 3, 2)}", s) for i, t, s in rows])
    assert all(found[i] == f"{t}\n{words(i % 3, 2)}" for i, t, _ in rows)


def test_short_lines_need_more_sites(spark):
    rows = [(i, f"{words(i, 9)}\nRead more\n \n{'On nine sites' if i % 12 < 9 else ''}", f"site{i % 12}") for i in range(48)]
    found = stage(spark, rows)
    assert all(found[i] == t.replace("Read more\n", "") for i, t, _ in rows)


def test_odd_rows(spark):
    frame = docs(spark, [*ODD, (30, "x", None)])
    found = line_dedup.remove_boilerplate(frame)
    assert set(found.columns) == set(frame.columns)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(repr, ((r.doc_id, r.text) for r in frame.collect())))
    assert line_dedup.remove_boilerplate(docs(spark, [])).collect() == []
