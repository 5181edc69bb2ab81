"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

1. Each text's distinct k-word shingles are hashed once. Texts with the same
   set collapse to one representative, so groups of exact copies cost nothing
   further.
2. Representatives get ``BANDS x ROWS`` MinHash samples. A set of fewer than
   ``LARGE`` shingles is hashed by that many functions; a larger one by one
   permutation cut into as many bins (sets near the border carry both kinds, so
   that a pair across it still meets). The samples are folded into a parity
   bitmap, the odd sketch; the population count of two bitmaps' XOR tells how
   many samples differ.
3. Representatives that share a band key are candidates. They are first held
   against the key's smallest document only, by sketch, and each one's most
   similar such document is confirmed on full sets. Components of these links
   leave few keys with more than one component.
4. In those keys, documents outside the component of the key's smallest are
   split where they are very many by the rarest hashes of their sets, of which
   similar sets must share one, and
   held against the key's others by sketch, block by block: first for their most
   similar neighbour alone, then, for what is left, for each component they may
   belong to. That is confirmed on full sets for the most similar member and,
   where it fails, against all members, again in blocks.

No step forms all pairs of a group and no group is gathered in one task. A
pair of Jaccard similarity s shares no key with a chance of
(1 - s^ROWS)^BANDS: 5e-6 at 0.8 and 6e-9 at 0.85; the sketches' margin is five
standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components, merged_components
from .scratch import Scratch, few, fresh
from .wordhash import chunks, mix, shingle_sets

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
LARGE = 1000
BITS = 512
#: Rows of one block when documents of a key, or sets of a component, are compared.
BLOCK_ROWS = 1024
BLOCK_HASHES = 1 << 16
#: Documents outside a key's first component, beyond which the key is split by the rarest hashes of its documents.
REBAND_ROWS = 4096
#: Ids up to this many are broadcast to filter texts; more are joined by shuffle.
BROADCAST_IDS = 2_000_000

_U = np.uint64
_A = mix(np.arange(1, SAMPLES + 1, dtype=_U)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(10_001, 10_001 + SAMPLES, dtype=_U)).astype(np.uint32) | np.uint32(1)
_PLACE = mix(np.arange(20_001, 20_001 + SAMPLES, dtype=_U))
_SIGNATURE = "n_shingles long, f1 long, f2 long, keys array<long>, small binary, large binary"


def _bands(samples: np.ndarray, full: np.ndarray, kind: int) -> list[np.ndarray]:
    """Band keys of each row of samples; a band with an empty bin has none."""
    s = samples.reshape(len(samples), BANDS, ROWS)
    key = np.full((len(samples), BANDS), kind + 1, dtype=_U) + _PLACE[:BANDS]
    for i in range(ROWS):
        key = mix(key * _U(0xD6E8FEB86659FD93) + s[:, :, i])
    ok = full.reshape(s.shape).all(axis=2)
    return [key[i][ok[i]].view(np.int64) for i in range(len(key))]


def _odd(samples: np.ndarray, full: np.ndarray) -> list[bytes]:
    """Parity bitmaps of BITS bits."""
    bit = (mix(samples ^ _PLACE) % _U(BITS)).astype(np.int64)
    at = np.arange(len(samples))[:, None] * BITS + bit
    counts = np.bincount(at[full], minlength=len(samples) * BITS)
    return [x.tobytes() for x in np.packbits((counts & 1).astype(bool).reshape(-1, BITS), axis=1)]


def _small_samples(sets: list[np.ndarray]) -> np.ndarray:
    joined = np.concatenate(sets)
    low, high = joined.astype(np.uint32), (joined >> _U(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), dtype=np.uint32)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat(low * _A[i] + high * _B[i], at)
    return out.astype(_U)


def _large_samples(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One permutation: s is sorted, so each bin's first value is its least."""
    bins = ((s >> _U(32)) * _U(SAMPLES)) >> _U(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    samples, full = np.zeros(SAMPLES, dtype=_U), np.zeros(SAMPLES, dtype=bool)
    at = bins[first].astype(np.int64)
    samples[at], full[at] = s[first], True
    return samples, full


def _signatures(texts: pa.Array, k: int) -> pa.RecordBatch:
    n, f1, f2, keys, small, large = [], [], [], [], [], []
    for _, words in chunks(texts, fold_case=True):
        sets = list(shingle_sets(words, k))
        base = len(n)
        for s in sets:
            n.append(len(s))
            if len(s):
                f1.append(int(np.bitwise_xor.reduce(mix(s)).view(np.int64)))
                f2.append(int(np.add.reduce(mix(s ^ _U(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
            else:
                f1.append(None)
                f2.append(None)
        keys += [None] * len(sets)
        small += [None] * len(sets)
        large += [None] * len(sets)
        few = [i for i, s in enumerate(sets) if 0 < len(s) < LARGE * 5 // 4]
        if few:
            samples = _small_samples([sets[i] for i in few])
            full = np.ones(samples.shape, dtype=bool)
            for i, key, odd in zip(few, _bands(samples, full, 0), _odd(samples, full), strict=True):
                keys[base + i], small[base + i] = key, odd
        many = [i for i, s in enumerate(sets) if len(s) >= LARGE]
        if many:
            samples, full = (np.stack(x) for x in zip(*(_large_samples(sets[i]) for i in many), strict=True))
            for i, key, odd in zip(many, _bands(samples, full, 1), _odd(samples, full), strict=True):
                keys[base + i] = key if keys[base + i] is None else np.concatenate((keys[base + i], key))
                large[base + i] = odd
    return pa.record_batch(
        [
            pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
            pa.array(small, pa.binary()), pa.array(large, pa.binary()),
        ],
        names=["n_shingles", "f1", "f2", "keys", "small", "large"],
    )


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                out = _signatures(part.column(1), k)
                yield pa.record_batch([part.column(0), *out.columns], names=["doc_id", *out.schema.names])

    return run


def odd_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of equal samples from XOR population counts (rows of bytes)."""
    z = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-2 * np.minimum(z, BITS / 2 - 1) / BITS)


def margin(similarity: float) -> float:
    """Least estimate of a candidate: five standard deviations of the samples and the bitmap below."""
    return similarity - 5 * (similarity * (1 - similarity) / SAMPLES) ** 0.5 * 1.15


def _bitmaps(column: pa.Array) -> np.ndarray:
    """Rows of BITS / 8 bytes; nulls are zeros."""
    return np.frombuffer(b"".join(x or bytes(BITS // 8) for x in column.to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)


def _estimate(similarity: float):
    least = margin(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = dict(zip(b.schema.names, b.columns, strict=True))
            both = np.asarray(c["a_small"].is_valid()) & np.asarray(c["b_small"].is_valid())
            e = np.where(both, odd_similarity(_bitmaps(c["a_small"]), _bitmaps(c["b_small"])), odd_similarity(_bitmaps(c["a_large"]), _bitmaps(c["b_large"])))
            keep = np.flatnonzero(e >= least)
            yield pa.record_batch([c["a"].take(pa.array(keep)), c["b"].take(pa.array(keep)), pa.array(e[keep])], names=["a", "b", "estimate"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Exactly: 100 |x and y| >= 100 similarity |x or y|, for sorted distinct arrays."""
    p = round(similarity * 100)
    if 100 * min(len(x), len(y)) < p * max(len(x), len(y)):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = int(np.count_nonzero(y[at] == x))
    return 100 * same >= p * (len(x) + len(y) - same)


def _confirm(k: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sides = [[s for _, w in chunks(part.column(c), fold_case=True) for s in shingle_sets(w, k)] for c in (2, 3)]
                ok = [bool(len(x)) and _linked(x, y, similarity) for x, y in zip(*sides, strict=True)]
                at = pa.array(np.flatnonzero(ok))
                yield pa.record_batch([part.column(0).take(at), part.column(1).take(at)], names=["a", "b"])

    return run


def _texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts (doc_id, text) of some ids. Ids are broadcast below a checked count, else joined by shuffle."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return texts.join(ids, "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough."""
    pairs = scratch.save(pairs.select("a", "b"), f"{name}-pairs")
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    some = scratch.save(_texts_of(texts, ids), f"{name}-texts")
    joined = pairs.join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    found = joined.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, similarity), "a long, b long")
    found = scratch.save(found.distinct(), f"{name}-links")
    scratch.drop(f"{name}-texts", f"{name}-pairs")
    return found


def _rest(similarity: float, every: bool):
    """Of blocks of keys: for each left document its most similar member of another component by sketch.

    With ``every`` there is one row for each such component, else one for each document and key.
    """
    least = margin(similarity)

    def compare(left: tuple, right: tuple, out: list) -> None:
        (li, lr, ln, lb, _), (ri, rr, rn, rb, outside) = left, right
        for at in range(0, len(li), 64):
            part = slice(at, at + 64)
            ok = lr[part, None] != rr[None]
            if every:  # of two components outside the key's first, the one with the larger root asks
                ok &= ~(outside[None] & (lr[part, None] < rr[None]))
            ok &= np.minimum(ln[part, None], rn[None]) >= similarity * np.maximum(ln[part, None], rn[None]) - 1e-9
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 1 << 17):
                x, y = i[k : k + (1 << 17)] + at, j[k : k + (1 << 17)]
                e = odd_similarity(lb[x], rb[y])
                hit = e >= least
                if hit.any():
                    x, y, e = x[hit], y[hit], e[hit]
                    out.append(_firsts(li[x], lr[x], ri[y], rr[y], e, every))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key", kind="stable")
        keys = pdf["key"].to_numpy()
        bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        left, ids, roots, sizes, outside = (pdf[c].to_numpy() for c in ("left", "doc_id", "root", "n_shingles", "outside"))
        out: list = []
        for kind in ("small", "large"):
            have = pdf[kind].notna().to_numpy()
            bits = np.zeros((len(pdf), BITS // 8), dtype=np.uint8)
            if have.any():
                bits[have] = np.frombuffer(b"".join(pdf[kind][have]), dtype=np.uint8).reshape(-1, BITS // 8)
            for u, v in zip(bounds[:-1], bounds[1:], strict=True):
                sides = [np.flatnonzero(have[u:v] & (left[u:v] == side)) + u for side in (True, False)]
                if len(sides[0]) and len(sides[1]):
                    compare(*((ids[x], roots[x], sizes[x], bits[x], outside[x]) for x in sides), out)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        columns = _firsts(*columns, every)
        return pd.DataFrame(dict(zip(("a", "root_a", "b", "root_b", "estimate"), columns, strict=True))).astype(
            {"a": "int64", "root_a": "int64", "b": "int64", "root_b": "int64", "estimate": "float64"}
        )

    return run


def _firsts(a, root_a, b, root_b, e, every: bool) -> tuple:
    """The row of the greatest estimate, then least b, for each a [and root_b]."""
    order = np.lexsort((b, -e, root_b, a)) if every else np.lexsort((b, -e, a))
    a, root_a, b, root_b, e = a[order], root_a[order], b[order], root_b[order], e[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = a[1:] != a[:-1]
    if every:
        new[1:] |= root_b[1:] != root_b[:-1]
    return a[new], root_a[new], b[new], root_b[new], e[new]


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [s.tobytes() for _, w in chunks(part.column(1), fold_case=True) for s in shingle_sets(w, k)]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "hashes"])

    return run


def _hashes(k: int):
    """One row for each hash of a text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                sets = [s for _, w in chunks(part.column(1), fold_case=True) for s in shingle_sets(w, k)]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ids = np.repeat(np.asarray(part.column(0)), sizes)
                # rows that share an id may have different sets
                which = np.repeat(np.array([np.bitwise_xor.reduce(s) for s in sets], dtype=_U).view(np.int64), sizes)
                yield pa.record_batch([pa.array(ids), pa.array(which), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate([*sets, np.zeros(0, dtype=_U)]).view(np.int64))], names=["doc_id", "which", "n", "key"])

    return run


def _rarest(texts: DataFrame, ids: DataFrame, k: int, similarity: float, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, key): of each set the hashes that fewest of these documents have, so many that two similar sets share one of them.

    Of x and y at least p/100 alike, y holds all of x but (100 - p)/100 of it at most; so,
    in one order of all hashes, their first common one is among the first of both.
    """
    p = round(similarity * 100)
    rows = scratch.save(_texts_of(texts, ids).distinct().mapInArrow(_hashes(k), "doc_id long, which long, n long, key long"), f"{name}-hashes")
    counts = rows.groupBy("key").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("doc_id", "which").orderBy("c", "key"))
    first = rows.join(counts, "key").withColumn("place", place)
    return first.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * p / 100) + 1).select("doc_id", "key").distinct()


def _blocks(similarity: float):
    """Links between the left and right sets of one block pair, at most one for each left document."""

    def run(pdf):
        import pandas as pd

        sets = [np.frombuffer(x, dtype=_U) for x in pdf["hashes"]]
        left = pdf["left"].to_numpy()
        ids = pdf["doc_id"].to_numpy()
        rows = []
        for i in np.flatnonzero(left):
            j = next((j for j in np.flatnonzero(~left) if ids[i] != ids[j] and _linked(sets[i], sets[j], similarity)), None)
            if j is not None:
                rows.append((ids[i], ids[j]))
        return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")

    return run


def _roots(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """nodes (doc_id, ...) with root, itself where it has no links."""
    found = components.withColumnRenamed("node", "doc_id")
    return nodes.join(found, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. Two documents are
    linked if their sets of distinct k-word shingles have a Jaccard similarity
    of at least ``similarity`` (whole hundredths); a text with fewer words has
    its whole sequence as one shingle. component_id: the smallest id reachable.

    Null, empty and wordless texts have n_shingles 0 and are linked with
    nothing. Ids are integers, or texts of integers. A null id comes back with
    component_id null and kept true. Repeated rows each get their row; rows that
    share an id count as one vertex. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dup")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.save(texts.mapInArrow(_sign(k), f"doc_id long, {_SIGNATURE}"), "signed")

    twins = signed.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    twins = scratch.save(twins, "twins")
    reps = signed.where("n_shingles > 0").join(twins.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = scratch.save(reps.drop("f1", "f2"), "reps")
    marks = reps.select("doc_id", "n_shingles", "small", "large")

    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("*").alias("m")).where("a < z")
    shared = scratch.save(shared.select("key", "a", "m"), "shared")
    members = scratch.save(keyed.join(shared, "key").select("key", "doc_id", "a", "m"), "members")
    n_members = members.count()

    def marked(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(marks.select(*(F.col(c).alias(x if c == "doc_id" else f"{x}_{c}") for c in marks.columns)), x)
        return pairs.where(F.least("a_n_shingles", "b_n_shingles") >= F.greatest("a_n_shingles", "b_n_shingles") * F.lit(similarity) - 1e-9)

    stars = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = marked(stars).mapInArrow(_estimate(similarity), "a long, b long, estimate double")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("estimate", -F.col("a"))).alias("a"))
    links = _confirmed(best, texts, k, similarity, scratch, "star")
    found = connected_components(links, scratch, "cc1")

    def rest(found: DataFrame, every: bool, name: str) -> DataFrame:
        """Candidates left in keys with more than one component, by sketch."""
        placed = scratch.save(_roots(members, found), f"{name}-roots", n_members)
        mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "lo")
        mixed = scratch.save(mixed, f"{name}-mixed", n_members)
        if mixed.isEmpty():
            return spark.createDataFrame([], "a long, root_a long, b long, root_b long")
        placed = scratch.save(placed.join(mixed, "key").select("key", "doc_id", "m", "root", "lo"), f"{name}-placed", n_members)
        n_placed = placed.count()
        # the first component of a key is on the right side only; documents outside of it meet all others, in blocks
        outside = placed.where("root <> lo").groupBy("key").agg(F.count("*").alias("outside"))
        sized = scratch.save(mixed.join(outside, "key").select("key", "outside"), f"{name}-sized", n_placed)
        hot = scratch.side(sized.where(F.col("outside") > REBAND_ROWS).select("key"), f"{name}-hot")
        if not hot.isEmpty():
            # similar documents share one of the rarest hashes of their sets, so none is lost where keys are too common
            again = placed.join(hot, "key").select("doc_id", "root").distinct()
            again = again.join(_rarest(texts, again.select("doc_id"), k, similarity, scratch, name), "doc_id").select("doc_id", "root", "key")
            again = scratch.save(again, f"{name}-two")
            lows = again.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").drop("hi")
            again = again.join(scratch.side(lows, f"{name}-lows"), "key").select("key", "doc_id", "m", "root", "lo")
            placed = scratch.save(placed.join(hot, "key", "left_anti").unionByName(again), f"{name}-placed2")
            n_placed = placed.count()
            outside = placed.where("root <> lo").groupBy("key").agg(F.count("*").alias("outside"))
            sized = scratch.save(outside, f"{name}-sized2", n_placed)
        n_left, n_right = F.ceil(F.col("outside") / BLOCK_ROWS).cast("int"), F.ceil(F.col("m") / BLOCK_ROWS).cast("int")
        rows = few(placed.join(sized, "key"), n_placed).withColumn("n_left", n_left).withColumn("n_right", n_right)
        # small keys are compared many at a time
        shards = max(1, n_placed // (4 * BLOCK_ROWS))
        shard = F.when((F.col("n_left") == 1) & (F.col("n_right") == 1), F.pmod(F.xxhash64("key"), F.lit(shards))).otherwise(F.col("key"))
        rows = rows.withColumn("shard", shard)
        left = rows.where("root <> lo").select(
            "shard", "key", "doc_id", "root", F.lit(True).alias("left"), F.lit(True).alias("outside"),
            F.pmod(F.xxhash64("doc_id"), F.col("n_left")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"),
        )
        right = rows.select(
            "shard", "key", "doc_id", "root", F.lit(False).alias("left"), (F.col("root") != F.col("lo")).alias("outside"),
            F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"), F.pmod(F.xxhash64("doc_id"), F.col("n_right")).cast("int").alias("j"),
        )
        blocks = left.unionByName(right).join(marks, "doc_id")
        maybe = blocks.groupBy("shard", "i", "j").applyInPandas(_rest(similarity, every), "a long, root_a long, b long, root_b long, estimate double")
        by = ["a", "root_a", "root_b"] if every else ["a", "root_a"]
        best = F.max_by(F.struct("b", "root_b"), F.struct("estimate", -F.col("b")))
        maybe = scratch.save(
            maybe.groupBy(*by).agg(best.alias("best")).select("a", "root_a", F.col("best.b").alias("b"), F.col("best.root_b").alias("root_b")),
            f"{name}-maybe", n_placed,
        )
        scratch.drop(*(f"{name}-{x}" for x in ("roots", "mixed", "placed", "sized", "hot", "hashes", "two", "lows", "placed2", "sized2")))
        return maybe

    def one_way(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    # most documents outside their key's first component belong to their most similar neighbour's
    near = rest(found, False, "near")
    old = merged_components(found, _confirmed(one_way(near), texts, k, similarity, scratch, "near"), scratch, "cc2")
    maybe = rest(old, True, "rest")
    found = merged_components(old, _confirmed(one_way(maybe), texts, k, similarity, scratch, "rest"), scratch, "cc3")

    # what is still apart is held against every member of the other component
    now = found.select(F.col("node").alias("x"), F.col("root").alias("now"))
    apart = maybe.join(
        now.withColumnRenamed("x", "a").withColumnRenamed("now", "na"), "a", "left",
    ).join(now.withColumnRenamed("x", "b").withColumnRenamed("now", "nb"), "b", "left")
    apart = apart.where("coalesce(na, a) <> coalesce(nb, b)").select("a", "root_b").distinct()
    member = old.select(F.col("root").alias("root_b"), F.col("node").alias("doc_id"))
    member = member.unionByName(old.select(F.col("root").alias("root_b"), F.col("root").alias("doc_id")).distinct())
    apart = scratch.save(apart.join(old.select(F.col("root").alias("root_b")).distinct(), "root_b", "left_semi"), "apart")
    if not apart.isEmpty():
        others = scratch.save(member.join(apart.select("root_b").distinct(), "root_b", "left_semi"), "others")
        ids = apart.select(F.col("a").alias("doc_id")).unionByName(others.select("doc_id")).distinct()
        hashes = scratch.save(_texts_of(texts, ids).mapInArrow(_sets(k), "doc_id long, hashes binary"), "sets")
        weight = F.greatest(F.lit(1), F.ceil(F.sum(F.length("hashes")) / 8 / BLOCK_HASHES)).cast("int")
        lefts = scratch.save(apart.withColumnRenamed("a", "doc_id").join(hashes, "doc_id"), "lefts")
        rights = scratch.save(others.join(hashes, "doc_id"), "rights")
        size = lefts.groupBy("root_b").agg(weight.alias("n_left")).join(rights.groupBy("root_b").agg(weight.alias("n_right")), "root_b")
        size = scratch.save(size, "sizes")
        lefts = lefts.join(size, "root_b").select(
            "root_b", "doc_id", "hashes", F.lit(True).alias("left"), F.pmod(F.xxhash64("doc_id"), F.col("n_left")).cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), F.col("n_right") - 1)).alias("j"),
        )
        rights = rights.join(size, "root_b").select(
            "root_b", "doc_id", "hashes", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("n_left") - 1)).alias("i"),
            F.pmod(F.xxhash64("doc_id"), F.col("n_right")).cast("int").alias("j"),
        )
        last = lefts.unionByName(rights).groupBy("root_b", "i", "j").applyInPandas(_blocks(similarity), "a long, b long")
        found = merged_components(found, scratch.save(last, "last"), scratch, "cc4")

    roots = _roots(twins.select(F.col("first").alias("doc_id"), "f1", "f2"), found).select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "root")
    roots = scratch.save(roots, "roots")
    slim = signed.select("doc_id", "n_shingles", "f1", "f2")
    out = slim.join(roots, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest id.

    All columns stay. Of rows that share an id the least row, in order of its
    columns, stays; rows without an id stay.
    """
    scratch = scratch or Scratch(docs.sparkSession, "near-dup")
    judged = scratch.save(near_duplicates(docs, id_col, text_col, k, similarity, scratch).select("doc_id", "kept"), "judged")
    mine = fresh(docs, "judged_id")
    same = F.col(id_col).cast("long") == F.col(mine)
    gone = scratch.side(judged.where("not kept").select(F.col("doc_id").alias(mine)).distinct(), "gone")
    left = docs.join(gone, same, "left_anti")
    again = judged.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mine))
    again = scratch.side(again, "again")
    if again.isEmpty():
        return left
    least = left.join(again, same, "left_semi").groupBy(F.col(id_col).alias(mine)).agg(F.min(F.struct(*docs.columns)).alias("row"))
    return left.join(again, same, "left_anti").unionByName(least.select("row.*"))
