import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa

from ledgerloom.llm import quality_pu, queries, samples, toxicity, wordhash

from .util import LONG, ODD, docs

SF = "/root/testdata/sf0.01"


def judged(spark, f, label):
    found = f(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    assert found["score"].between(0, 1).all()
    return found.merge(labels, on="doc_id").query("held_out").assign(y=lambda x: x[label])


def test_held_out_quality(spark):
    rows = judged(spark, queries.op7_quality_classifier, "quality")
    assert (rows["predicted"] == rows["y"]).mean() >= 0.95
    assert rows[rows["y"] == 1]["predicted"].mean() >= 0.98


def test_held_out_toxicity(spark):
    rows = judged(spark, queries.op4_toxicity, "toxic")
    assert (rows["predicted"] == rows["y"]).mean() >= 0.9
    assert rows[rows["y"] == 0]["predicted"].mean() <= 0.04


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(rng.normal(size=1 << toxicity.TABLE_BITS), -0.3, np.array([[0.0, -0.7], [-0.4, 0.9]]), np.zeros(4))
    places = rng.integers(0, 1 << toxicity.TABLE_BITS, size=(6, 7))
    p = chain.marginals(places, np.zeros(6, dtype=int), np.arange(6), np.zeros(1, dtype=int))
    score = chain.weights[places].sum(axis=1) + chain.bias
    weight = np.zeros(64)
    states = np.array([[(n >> i) & 1 for i in range(6)] for n in range(64)])
    for n, s in enumerate(states):
        weight[n] = np.exp((s * score).sum() + sum(chain.steps[s[i], s[i + 1]] for i in range(5)))
    assert np.allclose(p, (weight[:, None] * states).sum(axis=0) / weight.sum())


def test_marginals_over_segment_edges(monkeypatch):
    # segments of three tokens; documents of 8, 1, 3 and 7 tokens against enumeration of each
    monkeypatch.setattr(toxicity, "SEGMENT", 3)
    rng = np.random.default_rng(3)
    chain = toxicity.Chain(rng.normal(size=1 << toxicity.TABLE_BITS), -0.3, np.array([[0.0, -2.0], [-1.5, 1.0]]), np.zeros(4))
    doc = np.repeat([0, 1, 2, 5], [8, 1, 3, 7])
    places = rng.integers(0, 1 << toxicity.TABLE_BITS, size=(len(doc), 7))
    found = chain.marginals(places, *toxicity._segments(doc))
    for d in np.unique(doc):
        score = chain.weights[places[doc == d]].sum(axis=1) + chain.bias
        n = len(score)
        states = np.array([[(i >> j) & 1 for j in range(n)] for i in range(1 << n)])
        weight = np.exp((states * score).sum(axis=1) + chain.steps[states[:, :-1], states[:, 1:]].sum(axis=1))
        assert np.allclose(found[doc == d], (weight[:, None] * states).sum(axis=0) / weight.sum())


def test_an_id_is_learnt_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic: seen.append(texts))
    monkeypatch.setattr(quality_pu, "train", lambda p, u: seen.append((len(p), len(u))))
    frame = docs(spark, [(i % 3 + 1, f"text {i}") for i in range(60)])
    labels = spark.createDataFrame([(i % 3 + 1, 1, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    toxicity.fit(frame, labels)
    quality_pu.fit(frame, labels, unlabelled=3)
    assert len(seen[0]) == len(set(seen[0])) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2, 3))
    assert seen[1] == (len(seen[0]), 3)


def test_spans_are_toxic_words(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join(f"word{rng.integers(3000)}" for _ in range(80)) for _ in range(300)]
    texts = [t + (" Élan vilestuff, end" if i % 3 == 0 else "") for i, t in enumerate(clean)]
    chain = toxicity.train(texts[:240], np.array([i % 3 == 0 for i in range(240)]))
    found = toxicity.score(docs(spark, [(i, texts[i]) for i in range(240, 300)]), chain).toPandas()
    assert ((found["score"] >= 0.5) == (found["doc_id"] % 3 == 0)).all()
    for _, r in found[found["doc_id"] % 3 == 0].iterrows():
        assert any(texts[r.doc_id][s["start"] : s["end"]].endswith("vilestuff") or "vilestuff" in texts[r.doc_id][s["start"] : s["end"]] for s in r.spans)


def test_non_negative_risk_finds_the_prior():
    rng = np.random.default_rng(4)
    good = lambda n: rng.normal(1.5, 1, size=(n, quality_pu.N_FEATURES))
    bad = lambda n: rng.normal(-1.5, 1, size=(n, quality_pu.N_FEATURES))
    net = quality_pu.train(good(800), np.concatenate((good(900), bad(600))))
    assert abs(net.prior - 0.6) < 0.08
    assert (net.logit(good(300)) > 0).mean() > 0.97 and (net.logit(bad(300)) < 0).mean() > 0.95


def plain_chain(chain, text):
    """Score of one text: words one by one, forwards and backwards over the whole of it."""
    tokens = [w for _, w in wordhash.chunks(pa.array([text or ""], pa.large_string()), is_word=toxicity._IS_WORD, fold_case=True)][0]
    places = toxicity._indices(toxicity.token_features(tokens), tokens.doc)
    odds = [math.exp(min(30.0, max(-30.0, chain.bias + sum(float(chain.weights[i]) for i in row)))) for row in places]
    step = [[math.exp(x) for x in row] for row in chain.steps]
    ahead, behind = [], [(1.0, 1.0)]
    for e in odds:
        a, b = ahead[-1] if ahead else (None, None)
        x, y = (1.0, e) if a is None else (a * step[0][0] + b * step[1][0], (a * step[0][1] + b * step[1][1]) * e)
        ahead.append((x / (x + y), y / (x + y)))
    for e in reversed(odds[1:]):
        a, b = behind[-1]
        x, y = step[0][0] * a + step[0][1] * b * e, step[1][0] * a + step[1][1] * b * e
        behind.append((x / (x + y), y / (x + y)))
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, reversed(behind), strict=False)]
    inputs = (1.0, math.log(sum(p) + 1e-3), max(p, default=0.0), sum(p) / max(1, len(p)))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, sum(x * float(c) for x, c in zip(inputs, chain.calibration, strict=True))))))


def plain_measures(text):
    """A text's measurements, but for hashed words, from its bytes and words."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    n = max(1, len(words))
    shares = [sum(b in g for b in data) / max(1, len(data)) for g in quality_pu._GROUPS]
    shares.append(sum(not any(b in g for g in quality_pu._GROUPS) for b in data) / max(1, len(data)))
    mean = sum(map(len, words)) / n
    spread = max(0.0, sum(len(w) ** 2 for w in words) / n - mean**2) ** 0.5
    again = lambda k: (len(w := list(zip(*(words[i:] for i in range(k)), strict=False))) - len(set(w))) / max(1, len(w))
    return [
        *shares, math.log1p(len(words)), mean / 10, spread / 10, sum(65 <= w[0] <= 90 for w in words) / n, sum(w[-1] in b"!#%&*$|" for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, again(1), again(2), again(5), math.log1p(len(words) / (data.count(b"\n") + 1)),
    ]


def test_toxicity_query_equals_plain_scoring(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    chain = toxicity.fit(texts, spark.read.parquet(f"{sf}/labels.parquet"))
    found = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    for r in texts.collect():
        want = plain_chain(chain, r.text)
        assert abs(found[r.doc_id].score - want) < 1e-6 and found[r.doc_id].predicted == (found[r.doc_id].score >= 0.5)
    assert abs(toxicity.score(docs(spark, [(1, LONG)]), chain).first().score - plain_chain(chain, LONG)) < 1e-6


def test_quality_query_equals_plain_scoring(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    net = quality_pu.fit(texts, spark.read.parquet(f"{sf}/labels.parquet"))
    found = {r.doc_id: r for r in queries.op7_quality_classifier(spark, sf).collect()}
    for r in texts.collect():
        x = quality_pu.measures([w for _, w in wordhash.chunks(pa.array([r.text or ""], pa.large_string()))][0])[0]
        plain = plain_measures(r.text)
        assert np.allclose(x[: len(plain)], plain, atol=1e-9) and len(x) == len(plain) + quality_pu.WORD_BUCKETS
        z = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(z, column, strict=True)) + b) for column, b in zip(net.w1.T, net.b1, strict=True)]
        g = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert abs(found[r.doc_id].score - 1 / (1 + math.exp(-min(30.0, max(-30.0, g))))) < 1e-9 and found[r.doc_id].predicted == (found[r.doc_id].score >= 0.3)


def test_odd_rows(spark):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2, "x") for i in range(1, 10)] + [(None, 1, 1, "x"), (6, None, None, "x")],
        "doc_id long, quality int, toxic int, score string",
    )
    frame = docs(spark, ODD)
    for fit, score in ((toxicity.fit, toxicity.score), (quality_pu.fit, quality_pu.score)):
        found = score(frame, fit(frame, labels)).collect()
        assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
        assert len({r.score for r in found if r.doc_id in (6, 7, None)}) == 1
        empty = score(docs(spark, []), fit(docs(spark, []), labels.limit(0)))
        assert empty.collect() == []
    carried = toxicity.score(frame, toxicity.fit(frame, labels), carry=True).select("row.*")
    assert carried.columns == frame.columns


def test_samples_do_not_depend_on_layout(spark):
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r.doc_id for r in samples.sample_ids(x, 50, 1).collect()) for x in (ids, ids.repartition(7)))
    assert a == b and len(a) == 50 and isinstance(pd.Series(a).sum().item(), int)


def test_models_travel_without_the_package(spark):
    import pickle

    from ledgerloom.llm.scratch import shared

    for model in (toxicity.train([], np.zeros(0, dtype=bool)), quality_pu.train(np.zeros((0, 1)), np.zeros((0, 1)))):
        value = shared(spark, model).value
        assert b"ledgerloom" not in pickle.dumps(value)
        assert vars(type(model)(*value)).keys() == vars(model).keys()
