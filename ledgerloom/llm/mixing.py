"""Mixing sources to target weights by balanced sampling, with the cube method.

A source's target over its size says how often each of its documents is taken:
a whole number of times, and once more with what is left as a chance. Which
documents get the further copy is a balanced sample: chances move along
directions in which neither the sum of chances nor that of chances times sizes
changes (the null space of both constraints), until one of three documents in
hand is decided and the next takes its place. So blocks of documents fly on
their own, and leave two undecided each; those of all blocks fly again, until
one block a source is left. That one keeps a few documents out, each about half
as long as the one before, and lands them with the undecided two: all outcomes
are tried, and sizes in such steps add up to nearly any number of words.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Documents of one block; a block is one task's group.
BLOCK = 4096
#: Documents of a source that are kept for the landing.
LANDING = 12
#: At the landing, a document too many or too few is as bad as so many words.
DOCUMENT_WORDS = 4
#: Chances as near as this to 0 or 1 are decided.
NEAR = 1e-9
#: Repeats of one row that are written out as one array.
REPEATS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def flight(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """chances moved to 0 or 1, until at most two of them are undecided; they come in the order given.

    Neither the sum of chances nor that of chances times sizes changes, and the
    expectation of each chance is what it was. draws: a number in [0, 1) for each.
    """
    p, size, draw = chances.tolist(), sizes.tolist(), draws.tolist()
    waiting = iter([i for i, x in enumerate(p) if NEAR < x < 1 - NEAR])
    hand = list(itertools.islice(waiting, 3))
    step = 0
    while len(hand) == 3:
        a, b, c = (size[i] for i in hand)
        u = (b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(hand, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(hand, u, strict=True) if x)
        move = up if draw[step % len(draw)] * (up + down) < down else -down
        step += 1
        for i, x in zip(hand, u, strict=True):
            p[i] += move * x
        hand = [i for i in hand if NEAR < p[i] < 1 - NEAR]
        hand += itertools.islice(waiting, 3 - len(hand))
    return np.where((np.array(p) > NEAR) & (np.array(p) < 1 - NEAR), p, np.round(p))


def ladder(sizes: np.ndarray, steps: int) -> np.ndarray:
    """Places of so many sizes (all, if there are no more), each the nearest to half of the step before, from the largest on."""
    free = np.ones(len(sizes), dtype=bool)
    for k in range(min(steps, len(sizes))):
        free[np.argmin(np.where(free, np.abs(sizes - sizes.max() / 2**k), np.inf))] = False
    return np.flatnonzero(~free)


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """0 or 1 for each chance (a few at most): the outcome nearest in words and number, the first of equals."""
    m = len(sizes)
    bits = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    words = np.abs(bits @ sizes - (chances * sizes).sum())
    number = np.abs(bits.sum(axis=1) - chances.sum())
    return bits[np.argmin((words + DOCUMENT_WORDS * number).round(6))].astype(float)


def _fly(block: pa.Table) -> pa.Table:
    """One block with its chances moved; the last block of a source has them all decided."""
    draw = block["draw"].to_numpy()
    order = np.lexsort((draw, -block["size"].to_numpy()))
    sizes, chances = block["size"].to_numpy()[order].astype(float), block["chance"].to_numpy()[order]
    uniform = (draw[order].astype(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
    flying = np.ones(len(sizes), dtype=bool)
    last = block["last"][0].as_py()
    if last:
        flying[ladder(sizes, LANDING)] = False
    if flying.any():
        chances[flying] = flight(sizes[flying], chances[flying], uniform[flying])
    if last:
        undecided = (chances > 0) & (chances < 1)
        chances[undecided] = landing(sizes[undecided], chances[undecided])
    moved = np.empty(len(order))
    moved[order] = chances
    kept = block.select([c for c in block.column_names if c not in ("chance", "draw", "last", "block")])
    return kept.append_column("chance", pa.array(moved, pa.float64()))


def sources(units: DataFrame, weights: tuple[float, ...], most: float, scratch: Scratch) -> DataFrame:
    """(source, source_no, source_size, target, base, rate) of units (source, size, n), saved; base whole copies and a rate of further ones.

    Sources come in the order of their code points, null last, and have the
    weights in turn, over and over. A target is at most `most` times its source's
    size; what is above goes to the others by weight, until none is above. Sources
    without words have the target 0.
    """
    rows = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # numbered in their order without bringing all to one task
    placed = scratch.save(rows.sort(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "placed")
    before = F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    parts = placed.groupBy("part").agg(F.count("*").alias("k")).select("part", before.alias("before"))  # one row a partition
    in_part = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    rows = placed.join(F.broadcast(parts), "part").withColumn("source_no", F.col("before") + in_part - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    rows = scratch.save(rows.select("source", "source_no", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "weighed")
    level, n_capped = 0.0, -1
    while True:  # each round caps a source more, or is the last
        capped = F.col("cap") < F.col("weight") * F.lit(level)
        sums = rows.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)).alias("free"), F.count_if(capped).alias("n"),
        ).first()
        if sums.n == n_capped or not sums.free:
            break
        level, n_capped = (sums.all - sums.fixed) / sums.free, sums.n
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("target", target).withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    return scratch.side(rows.select("source", "source_no", "source_size", "target", "base", (F.col("rate") - F.col("base")).alias("rate")), "sources")


def _decided(units: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """units (source_no, doc_id, size, n, whole, chance) with each chance 0 or 1."""
    done: list[DataFrame] = []
    level = 0
    is_open = (F.col("chance") > NEAR) & (F.col("chance") < 1 - NEAR)
    while True:
        counts = scratch.side(units.where(is_open).groupBy("source_no").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")), f"blocks-{level}")
        most = counts.agg(F.max("blocks")).first()[0]
        done.append(units.where(~is_open))
        if most is None:
            break
        draw = F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level))
        rows = units.where(is_open).join(counts, "source_no").withColumn("draw", draw)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("draw"), F.col("blocks"))).withColumn("last", F.col("blocks") == 1).drop("blocks")
        flown = rows.groupBy("source_no", "block").applyInArrow(_fly, units.schema)
        units = scratch.save(flown, f"flight-{level}")
        level += 1
        if most == 1:
            done.append(units)
            break
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", scratch: Scratch | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of docs: how often the mix takes it.

    size: words `[^\\x20\\x09-\\x0D]+` of the text; null, empty and blank texts have
    none. The mix has as many words as docs; a source's share goes by its weight
    (see `sources`), and taken = copies * size, where copies is target / source_size
    cut down, or one more. Rows alike in source, id and size are interchangeable
    and counted together, so it doesn't matter how often a row comes or where.
    Null sources are one source, null ids one id. The same rows with the same
    seed give the same mix, however they are laid out. A source's words miss the
    target by what the landing leaves, a few words where it has more than a handful
    of documents, and half a document at most where it has one. An
    empty table gives an empty one; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("doc_id"), size.alias("size"))
    units = scratch.save(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "units")
    known = sources(units, weights, most, scratch)
    numbered = units.join(known.select(F.col("source").alias("s"), "source_no", "rate"), F.col("source").eqNullSafe(F.col("s")))
    share = F.col("n") * F.col("rate")
    numbered = numbered.select("source_no", "doc_id", "size", "n", F.floor(share + NEAR).cast("long").alias("whole"), share.alias("share"))
    chance = F.greatest(F.col("share") - F.col("whole"), F.lit(0.0))
    decided = _decided(scratch.save(numbered.withColumn("chance", chance).drop("share"), "numbered"), seed, scratch)
    more = (F.col("whole") + F.round("chance")).cast("long")  # of the n rows, so many are taken once more
    rows = decided.withColumn("more", more).join(known.drop("source", "rate"), "source_no")
    single = rows.where("n = 1").withColumn("copies", F.col("base") + F.col("more"))
    first = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {REPEATS}")))
    many = rows.where("n > 1").withColumn("chunk", first).withColumn("first", F.col("chunk") * REPEATS).repartition("source_no", "doc_id", "size", "chunk")
    many = many.withColumn("at", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + REPEATS, F.col("n")) - 1)))
    many = many.withColumn("copies", F.col("base") + F.when(F.col("at") < F.col("more"), 1).otherwise(0))
    shown: Callable[[DataFrame], DataFrame] = lambda d: d.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )
    return shown(single).unionByName(shown(many))
