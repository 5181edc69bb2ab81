"""What filters remove in every order of applying them.

The orders of n filters form a trie. Its nodes with the same set of filters
behind them hold the same survivors, whatever their order, so of the trie only
2^n states are executed, depth first: a state's survivors are persisted, all
edges that leave it are counted in one aggregation, and each filter makes the
survivors of a deeper state from them. Only the states between the root and the
one at work are persisted at a time. A state met again is taken from memory of
what was counted.
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, few

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


#: Letter of a filter to what a text fails by; E, for copies, is found over the whole table.
FILTERS = {
    "A": lambda t, words: F.size(words) < 200,
    "B": lambda t, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda t, words: 100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.length(t),
    "D": lambda t, words: t.rlike("[#$%&*|]"),
}
COPIES = "E"


def _key(text: Column) -> Column:
    """128 bits of hash."""
    return F.struct(F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) for each row: the filters that it fails, true or false, judged on its own.

    A: under 200 words; B: less than half of the words are different; C: more than
    3 % of the code points are A-Z; D: any of #$%&*|; E: the same text under a
    smaller id, anywhere. A null text is an empty one, a null part an empty string.
    Rows without an id have no smaller one and are no smaller one; of rows that
    repeat id and text none fails E by another.
    """
    scratch = scratch or Scratch(docs.sparkSession, "filter-audit")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    judged = rows.withColumn("words", _words(F.col("text"))).select(
        "doc_id", "part", _key(F.col("text")).alias("k"), *(f(F.col("text"), F.col("words")).alias(x) for x, f in FILTERS.items())
    )
    judged = scratch.save(judged, "judged")
    firsts = judged.groupBy("k").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("k", "least")
    copied = judged.join(scratch.side(firsts, "firsts"), "k", "left")
    return copied.select("doc_id", "part", *FILTERS, F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias(COPIES))


def removals(rows: DataFrame, filters: str, marks: tuple[str, ...], scratch: Scratch, n_edges: int) -> DataFrame:
    """(part, state, filter, removed, mark...) for each edge of the trie: what a filter removes from the survivors of a set of filters.

    rows: part, a boolean for each filter (true: fails) and for each mark. state:
    the letters of the filters behind, in order. Parts of which a state has no
    survivor left are not among its rows. n_edges: of the root, or about.
    """
    told = f"{scratch.root}/edges"
    executed: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        executed.add(state)
        ahead = [f for f in filters if f not in state]
        if not ahead:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        counts = [c.alias(f"{f}_{name}") for f in ahead for name, c in (("removed", F.count_if(F.col(f))), *((m, F.count_if(F.col(f) & F.col(m))) for m in marks))]
        edges = F.array(*(
            F.struct(F.lit(f).alias("filter"), F.col(f"{f}_removed").alias("removed"), *(F.col(f"{f}_{m}").alias(m) for m in marks)) for f in ahead
        ))
        counted = survivors.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), F.inline(edges))
        few(counted, n_edges).write.mode("append").parquet(told)
        for f in ahead:
            deeper = "".join(sorted(state + f))
            if deeper not in executed:
                visit(deeper, survivors.where(~F.col(f)).drop(f))
        survivors.unpersist()

    visit("", rows)
    return rows.sparkSession.read.parquet(told)


def interactions(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters: str = "ABCDE",
    scratch: Scratch | None = None,
) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    labels: doc_id, quality, toxic; a document is good, or toxic, if any row of its
    id says 1, and neither without one. Texts, parts and repeated rows: see `verdicts`. Each row of
    docs counts, also where ids repeat. An empty table gives no part and so no row.
    shapley is the sum of what the step's filter removes over all orders; over
    their number it is the filter's Shapley value.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "filter-audit")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("bad"),
    )
    known = scratch.side(known.where("good or bad"), "known")
    rows = verdicts(docs, id_col, text_col, part_col, scratch).join(known, "doc_id", "left")
    rows = scratch.save(rows.select("part", *filters, *(F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("good", "bad"))), "rows")
    sizes = scratch.side(rows.groupBy("part").agg(F.count("*").alias("n_docs")), "sizes")
    total = sizes.agg(F.count("*").alias("parts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs")).first()
    n_edges = total.parts * len(filters)
    edges = removals(few(rows, total.docs), filters, ("good", "bad"), scratch, n_edges)
    edges = scratch.save(edges, "all-edges", rows=n_edges << len(filters))
    orders = [
        ("".join(o), i + 1, o[i], "".join(sorted(o[:i])))
        for o in itertools.permutations(filters) for i in range(len(filters))
    ]
    steps = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, filter string, state string"))
    total_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ways = F.array(*(F.lit(math.factorial(k) * math.factorial(len(filters) - 1 - k)) for k in range(len(filters))))
    # the root's edges are there for every part and filter
    whole = edges.groupBy("part", "filter").agg(
        total_of(F.when(F.col("state") == "", F.col("removed"))).alias("fails"),
        total_of(F.when(F.length("state") == len(filters) - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * F.get(ways, F.length("state"))).alias("shapley"),
    )
    rows = whole.join(steps, "filter").join(edges, ["part", "state", "filter"], "left").join(sizes, "part")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    behind = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(
        "part", "filter_order", "step", (F.col("n_docs") - F.sum(zero("removed")).over(behind)).alias("kept"), zero("removed").alias("removed"),
        (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails", zero("good").alias("good_lost"), zero("bad").alias("toxic_lost"), "shapley",
    )
