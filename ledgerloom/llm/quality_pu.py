"""Quality classifier from positive and unlabelled texts.

Trusted good documents are the positives; web text, whatever its labels, is
unlabelled. The share of good text among the unlabelled is estimated, and a
small network minimises the non-negative unbiased risk: the positives' risk at
that share, plus what the unlabelled risk exceeds the positives' part of it,
never below zero.

Texts are measured on the executors; only measurements of a bounded sample
reach the driver: at most ``TRAIN_POSITIVES`` and ``TRAIN_UNLABELLED`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import held_out, sample_ids
from .scratch import shared, small_batches
from .wordhash import NON_SPACE, Words, chunks, mix

TRAIN_POSITIVES = 6000
TRAIN_UNLABELLED = 12_000
HIDDEN = 16
STEPS = 400
#: Buckets of words, each counted up or down by a sign of its own.
WORD_BUCKETS = 64

#: Groups of bytes whose shares of a text are measured.
_GROUPS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".", b",", b"|", b"#", b"%", b"&", b"*", b"$", b"<>",
    b"\n", b"'\"", b"()[]{}", b":;", b"-_", b"/\\@", bytes(range(0x80, 0x100)),
]
_GROUP = np.full(256, len(_GROUPS))
for _i, _g in enumerate(_GROUPS):
    _GROUP[list(_g)] = _i
N_FEATURES = len(_GROUPS) + 1 + 10 + WORD_BUCKETS


def measures(w: Words) -> np.ndarray:
    """(texts, N_FEATURES): shares of byte groups, word lengths, repetition of words, pairs and lines, and hashed words."""
    n, n_groups = w.n_docs, len(_GROUPS) + 1
    size = np.diff(w.offsets)
    doc_of_byte = np.repeat(np.arange(n), size)
    counts = np.bincount(doc_of_byte * n_groups + _GROUP[w.data], minlength=n * n_groups).reshape(n, n_groups)
    shares = counts / np.maximum(1, size)[:, None]
    words = w.counts()
    some = np.maximum(1, words)
    length = (w.end - w.start).astype(float)
    mean = np.bincount(w.doc, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(w.doc, weights=length**2, minlength=n) / some - mean**2))
    first_byte = w.data[w.start] if len(w.start) else np.zeros(0, dtype=np.uint8)
    capital = np.bincount(w.doc, weights=(first_byte >= 65) & (first_byte <= 90), minlength=n) / some
    last_byte = w.data[w.end - 1] if len(w.end) else np.zeros(0, dtype=np.uint8)
    marked = np.bincount(w.doc, weights=np.isin(last_byte, np.frombuffer(b"!#%&*$|", dtype=np.uint8)), minlength=n) / some

    def repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        return np.bincount(doc[order][1:][same], minlength=n) / np.maximum(1, np.bincount(doc, minlength=n))

    twice = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
    twice = np.bincount(w.doc[twice], minlength=n) / some
    two, h2 = w.windows(2)
    five, h5 = w.windows(5)
    lines = counts[:, 14] + 1
    h = mix(w.hash)
    sign = (h >> np.uint64(32) & np.uint64(1)).astype(float) * 2 - 1
    bucket = (h % np.uint64(WORD_BUCKETS)).astype(np.int64)
    bag = np.bincount(w.doc * WORD_BUCKETS + bucket, weights=sign, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS) / np.sqrt(some)[:, None]
    return np.column_stack(
        (
            shares, np.log1p(words), mean / 10, spread / 10, capital, marked, twice, repeated(w.doc, w.hash), repeated(w.doc[two], h2),
            repeated(w.doc[five], h5), np.log1p(words / lines), bag,
        )
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [np.zeros((0, N_FEATURES))] + [measures(w) for _, w in chunks(b.column(1), is_word=NON_SPACE)]
        x = np.concatenate(x)
        yield pa.record_batch([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


@dataclass
class Network:
    """One hidden layer over standardised measurements; prior: the estimated share of good text."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        # sums in one order, however many rows there are: equal texts have equal scores
        hidden = np.maximum(0, np.einsum("ij,jk->ik", z, self.w1) + self.b1)
        return np.einsum("ij,j->i", hidden, self.w2) + self.b2


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int, mean: np.ndarray, scale: np.ndarray) -> Network:
    """With a prior: the non-negative risk. Without: plain separation of positives from unlabelled."""
    rng = np.random.default_rng(seed)
    k = p.shape[1]
    net = Network(mean, scale, rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0, prior or 0.0)
    z = np.clip((np.concatenate((p, u)) - mean) / scale, -8, 8)
    n = len(p)
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (net.w1, net.b1, net.w2, np.zeros(1))]
    for step in range(1, STEPS + 1):
        hidden = np.maximum(0, z @ net.w1 + net.b1)
        g = np.clip(hidden @ net.w2 + net.b2, -30, 30)
        s = 1 / (1 + np.exp(-g))
        d = np.empty(len(z))
        if prior is None:
            d[:n], d[n:] = (s[:n] - 1) / n, s[n:] / len(u)
        else:
            negative = np.log1p(np.exp(g[n:])).mean() - prior * np.log1p(np.exp(g[:n])).mean()
            if negative >= 0:
                d[:n], d[n:] = prior * ((s[:n] - 1) - s[:n]) / n, s[n:] / len(u)
            else:  # the estimate fell below zero: step back
                d[:n], d[n:] = prior * s[:n] / n, -s[n:] / len(u)
        back = d[:, None] * net.w2[None] * (hidden > 0)
        grads = [z.T @ back + 1e-4 * net.w1, back.sum(axis=0), hidden.T @ d + 1e-4 * net.w2, np.array([d.sum()])]
        new = []
        for v, grad, m in zip((net.w1, net.b1, net.w2, np.array([net.b2])), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.999 * m[1] + 0.001 * grad**2
            new.append(v - 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        net.w1, net.b1, net.w2, net.b2 = new[0], new[1], new[2], float(new[3][0])
    return net


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in u from scores of both, higher for positives.

    Above any threshold the unlabelled share is at least the prior times the
    positives' share; the least ratio, with a bound for chance, estimates it.
    """
    cuts = np.quantile(p, np.linspace(0, 0.9, 46))
    top_p = np.array([(p >= c).mean() for c in cuts])
    top_u = np.array([(u >= c).mean() for c in cuts])
    slack = 1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u))
    best = int(np.argmin((top_u + slack) / top_p))
    return float(np.clip(top_u[best] / top_p[best], 0.02, 0.98))


def train(p: np.ndarray, u: np.ndarray, seed: int = 5) -> Network:
    """A network from measurements of positives and unlabelled. Without one of them every score is 1/2."""
    if not len(p) or not len(u):
        return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 0.5)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    # halves judge each other, so that the prior is not read off fitted scores
    first = _fit(p[::2], u[::2], None, seed, mean, scale)
    prior = estimate_prior(first.logit(p[1::2] if len(p) > 1 else p), first.logit(u[1::2] if len(u) > 1 else u))
    return _fit(p, u, prior, seed, mean, scale)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*model.value)
        for b in batches:
            s = [np.zeros(0)]
            for _, w in chunks(b.column(1), is_word=NON_SPACE):
                g = np.clip(net.logit(measures(w)), -30, 30)
                s.append(1 / (1 + np.exp(-g)))
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(s))], names=["doc_id", "score"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", positives: int = TRAIN_POSITIVES,
    unlabelled: int = TRAIN_UNLABELLED,
) -> Network:
    """A network from labelled good documents that are not held out, and any documents as unlabelled.

    An id counts once, with the least of its texts.
    """
    small_batches(docs.sparkSession)
    good = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y = 1")
    good = good.where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    p_ids = sample_ids(good, positives, 2).withColumn("positive", F.lit(True))
    u_ids = sample_ids(texts.select("doc_id").distinct(), unlabelled, 3).withColumn("positive", F.lit(False))
    some = texts.join(F.broadcast(p_ids.select("doc_id").unionByName(u_ids.select("doc_id")).distinct()), "doc_id")
    some = some.groupBy("doc_id").agg(F.min("text").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    x = some.mapInArrow(_measured, f"doc_id {kind}, x array<double>")
    rows = x.join(F.broadcast(p_ids.unionByName(u_ids)), "doc_id").toPandas().sort_values(["positive", "doc_id"])
    by = {k: np.array(rows["x"][rows["positive"] == k].tolist()).reshape(-1, N_FEATURES) for k in (True, False)}
    return train(by[True], by[False])


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, the chance of good quality) of every document.

    Null, empty and wordless texts are measured as zeros and scored like any
    other. Rows are judged one by one from their text alone; repeated rows get
    equal scores; an empty table gives an empty one; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = shared(docs.sparkSession, net)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(_scored(model), f"doc_id {kind}, score double")
