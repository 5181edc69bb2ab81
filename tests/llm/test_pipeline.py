import corpus_pipeline
import duckdb

from ledgerloom.llm import oracles, toxicity
from ledgerloom.llm.scratch import Scratch

from .test_classifiers import plain_chain
from .test_decontamination import brute as contaminated_by
from .test_near_dup import brute as groups_of
from .test_packing import check
from .util import docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf):
    scratch = Scratch(spark, "t")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    before, frames = {}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before[name], frames[name] = {r.doc_id: r.text for r in now.collect()}, now
        now = scratch.save(stage(spark, now, sf), name)
        assert now.columns == COLUMNS
    after = {r.doc_id: r for r in now.collect()}
    # toxic documents go, others stay
    chain = toxicity.fit(frames["toxicity"], spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(before["line_dedup"]) == {i for i, t in before["toxicity"].items() if plain_chain(chain, t) < corpus_pipeline.TOXIC}
    # lines are cut, documents are not
    con = duckdb.connect()
    con.register("documents", frames["line_dedup"].toPandas())
    assert {i: t for i, t, _ in con.execute(oracles.ORACLES["op1_line_dedup"]).fetchall()} == before["minhash_near_dedup"]
    # one of each group
    groups = groups_of(list(before["minhash_near_dedup"].items()), 5, 80)
    assert set(before["benchmark_decontamination"]) == {i for i, (_, low) in groups.items() if i == low}
    # contaminated documents go
    texts = before["benchmark_decontamination"]
    assert set(after) == {i for i, t in texts.items() if not contaminated_by(t, items)[4]}
    assert all(r.n_chars == len(r.text) for r in after.values())
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    rows = packed.collect()
    assert {r.doc_id for r in rows} == set(after)
    # the sequences hold what the tokenizer makes of the cleaned texts
    assert check(rows, {i: r.text for i, r in after.items()}, 2048, "<u2")
    assert sorted((r.doc_id, r.piece, r.length, bytes(r.ids)) for r in rows) == sorted(
        (r.doc_id, r.piece, r.length, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()
    )


def test_pipeline_of_no_documents(spark, tmp_path, sf):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs(spark, []).select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert check([], {}, 2048) == 0
