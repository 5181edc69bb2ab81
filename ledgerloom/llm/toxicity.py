"""Toxic spans and scores from a linear-chain conditional random field.

Labels come by document. The words and word beginnings that best tell toxic
documents from clean ones, found by greedy cover, label the tokens. A chain of
two states over hashed token features is trained on those; forward-backward
marginals give each token's chance of being toxic. Spans of likely tokens are
the offending offsets, and a document's marginals make its score.

A document is one chain. It is computed in segments of ``SEGMENT`` tokens, all
of a batch at once: each segment is first reduced to the 2 x 2 matrix of its
steps, messages pass from segment to segment through those, and then run
inside all segments together. Training takes segments one by one: at most
``TRAIN_SEGMENTS`` of at most ``TRAIN_DOCS`` documents of each class, of at most
``TRAIN_CHARS`` characters each; scoring reads all texts whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import _TABLE
from .samples import held_out, sample_ids
from .scratch import shared, small_batches
from .wordhash import Words, _powers, chunks, mix, shingle_sets

SEGMENT = 64
TABLE_BITS = 18
TRAIN_DOCS = 1500
TRAIN_CHARS = 10_000
TRAIN_SEGMENTS = 12_000
EPOCHS = 40
#: Most frequent telling features among which the greedy cover of labels chooses.
COVER_FEATURES = 4000

_U = np.uint64
_IS_WORD = np.array([b != 32 for b in _TABLE])
_SALTS = mix(np.arange(101, 109, dtype=_U))


def token_features(w: Words) -> np.ndarray:
    """Hashes (tokens, 5) of each word itself and its first 3, 4, 5 and 6 bytes."""
    n = len(w.hash)
    out = np.empty((n, 5), dtype=_U)
    out[:, 0] = w.hash ^ _SALTS[0]
    length = w.end - w.start
    folded = np.frombuffer(_TABLE, dtype=np.uint8)
    powers = _powers(8)
    h = np.zeros(n, dtype=_U)
    for i in range(6):
        have = length > i
        at = np.minimum(w.start + i, max(len(w.data) - 1, 0))
        h = h + np.where(have, (folded[w.data[at]].astype(_U) + _U(1)) * mix(powers[i : i + 1]), _U(0)) if n else h
        if i >= 2:
            out[:, i - 1] = mix(h ^ _SALTS[i - 1]) ^ _U(i)
    return out


def _indices(features: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Table places (tokens, 7): the token's features, and the words before and after it."""
    n = len(features)
    shift = _U(64 - TABLE_BITS)
    places = np.zeros((n, 7), dtype=np.int32)
    places[:, :5] = mix(features) >> shift
    if n > 1:
        same = doc[1:] == doc[:-1]
        word = features[:, 0]
        places[1:, 5] = np.where(same, mix(word[:-1] ^ _SALTS[6]) >> shift, _U(0))
        places[:-1, 6] = np.where(same, mix(word[1:] ^ _SALTS[7]) >> shift, _U(0))
    return places


def _segments(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and place in it of each token, and for each segment the number of segments of its document before it."""
    if not len(doc):
        return (np.zeros(0, dtype=np.int64),) * 3
    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    at = np.arange(len(doc)) - np.repeat(start, np.diff(np.concatenate((start, [len(doc)]))))
    fresh = at % SEGMENT == 0
    return np.cumsum(fresh) - 1, at % SEGMENT, at[fresh] // SEGMENT


def _unit(x: np.ndarray) -> np.ndarray:
    """Vectors (n, 2), or matrices (n, 2, 2), of sum one; scale tells nothing here."""
    if x.ndim == 2:
        return x / (x[:, 0] + x[:, 1])[:, None]
    return x / (x[:, 0, 0] + x[:, 0, 1] + x[:, 1, 0] + x[:, 1, 1])[:, None, None]


@dataclass
class Chain:
    """Weights of state toxic over state clean, and of transitions [from, to] in logs."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray
    calibration: np.ndarray

    def _ends(self, e: np.ndarray, live: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Messages (segments, 2) into each segment from those before it, and from those after it, of its document."""
        n, m = len(before), np.exp(self.steps)
        into, back = np.ones((n, 2)), np.ones((n, 2))
        if not before.any():
            return into, back
        order = np.argsort(before, kind="stable")
        bounds = np.searchsorted(before[order], np.arange(before.max() + 2))
        through = np.broadcast_to(np.eye(2), (n, 2, 2)).copy()
        for t in range(SEGMENT):
            # a document's first token has no step into it
            step = through @ m if t else np.where((before > 0)[:, None, None], through @ m, through)
            step[:, :, 1] *= e[t][:, None]
            through = np.where(live[t][:, None, None], _unit(step), through)
        for r in range(1, len(bounds) - 1):
            here = order[bounds[r] : bounds[r + 1]]
            into[here] = _unit(np.einsum("ni,nij->nj", into[here - 1], through[here - 1]))
        for r in range(len(bounds) - 2, 0, -1):
            here = order[bounds[r] : bounds[r + 1]]
            back[here - 1] = _unit(np.einsum("nij,nj->ni", through[here], back[here]))
        return into, back

    def marginals(self, places: np.ndarray, segment: np.ndarray, at: np.ndarray, before: np.ndarray, pairs: bool = False):
        """Chance of toxic for each token; with pairs also expected transitions (2, 2) inside segments.

        before: for each segment, how many segments of its document come right
        before it; with zeros alone each segment is a chain of its own.
        """
        n = len(before)
        score = np.zeros((SEGMENT, n), dtype=np.float64)
        live = np.zeros((SEGMENT, n), dtype=bool)
        one = np.full(len(places), self.bias)
        for column in places.T:
            one += self.weights[column]
        score[at, segment] = one
        live[at, segment] = True
        m = np.exp(self.steps)
        e = np.exp(np.clip(score, -30, 30))
        into, after = self._ends(e, live, before)
        a = np.empty((SEGMENT, n, 2))
        a[0] = np.where((before > 0)[:, None], into @ m, 1.0)
        a[0, :, 1] *= e[0]
        a[0] = _unit(a[0])
        for t in range(1, SEGMENT):
            step = a[t - 1] @ m
            step[:, 1] *= e[t]
            a[t] = np.where(live[t][:, None], _unit(step), a[t - 1])
        b = np.empty((SEGMENT, n, 2))
        b[-1] = after
        both = np.zeros((2, 2))
        for t in range(SEGMENT - 2, -1, -1):
            ahead = b[t + 1].copy()
            ahead[:, 1] *= e[t + 1]
            on = live[t + 1][:, None]
            if pairs:
                now, then = a[t][live[t + 1]], ahead[live[t + 1]]
                scale = 1 / np.einsum("ni,ij,nj->n", now, m, then)
                both += (now * scale[:, None]).T @ then * m
            b[t] = np.where(on, _unit(ahead @ m.T), b[t + 1])
        p = a * b
        p = p[:, :, 1] / (p[:, :, 0] + p[:, :, 1])
        return (p[at, segment], both) if pairs else p[at, segment]


def _cover(feature: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Features that stand in toxic documents and in almost no clean ones.

    All those too frequent for chance are taken. Then, greedily, the feature
    with the most toxic documents not yet covered, weighed by its log-odds, is
    added until none covers five more (fewer, if there are few toxic documents).
    """
    feature = feature.view(np.int64)
    order = np.lexsort((doc, feature))
    feature, doc = feature[order], doc[order]
    new = np.concatenate(([True], (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1])))[: len(feature)]
    feature, doc = feature[new], doc[new]
    names, first, counts = np.unique(feature, return_index=True, return_counts=True)
    hits = np.add.reduceat(toxic[doc].astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    ratio = ((hits + 0.5) / n1) / ((counts - hits + 0.5) / n0)
    need = max(2, min(5, n1 // 50))
    good = np.flatnonzero((hits >= need) & (ratio >= min(20, n1 / 4)))
    good = good[np.argsort(-hits[good], kind="stable")][:COVER_FEATURES]
    docs = {int(i): doc[first[i] : first[i] + counts[i]] for i in good}
    open_ = toxic.copy()
    taken = []
    for i in [i for i in docs if hits[i] >= max(20, n1 // 200)]:
        taken.append(names[i])
        open_[docs.pop(i)] = False
    while docs:
        best = max(docs, key=lambda i: (open_[docs[i]].sum() * np.log(ratio[i]), -i))
        if open_[docs[best]].sum() < need:
            break
        taken.append(names[best])
        open_[docs.pop(best)] = False
    return np.sort(np.array(taken, dtype=np.int64))


def _unlike(texts: list[str]) -> np.ndarray:
    """Places of texts of which less than a third of the five-word passages stand in an earlier one kept."""
    seen: set[int] = set()
    kept = []
    for first, w in chunks(pa.array(texts, pa.large_string()), is_word=_IS_WORD, fold_case=True):
        for i, s in enumerate(shingle_sets(w, 5)):
            some = set(s[(s % _U(4)) == 0].tolist() or s[:1].tolist())
            if 3 * len(some & seen) < len(some) or not some:
                seen |= some
                kept.append(first + i)
    return np.array(kept, dtype=np.int64)


def _document_inputs(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, 4): one, log of expected toxic tokens, greatest marginal, share of expected toxic tokens."""
    total = np.bincount(doc, weights=p, minlength=n_docs)
    size = np.maximum(1, np.bincount(doc, minlength=n_docs))
    most = np.zeros(n_docs)
    np.maximum.at(most, doc, p)
    return np.stack((np.ones(n_docs), np.log(total + 1e-3), most, total / size), axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - q) - ridge * w)
    return w


def _learnt(features: np.ndarray, places: np.ndarray, doc: np.ndarray, toxic: np.ndarray, some: np.ndarray, seed: int) -> Chain:
    """A chain, not calibrated, from the tokens of some documents (mask)."""
    size = 1 << TABLE_BITS
    share = some.mean()
    if share < 1:  # the whole is not copied
        mine = some[doc]
        features, places, doc, toxic = features[mine], places[mine], (np.cumsum(some) - 1)[doc[mine]], toxic[some]
    chain = Chain(np.zeros(size), -2.0, np.zeros((2, 2)), np.zeros(4))
    if not len(doc):
        return chain
    taken = _cover(features.reshape(-1), np.repeat(doc.astype(np.int32), 5), toxic)
    label = np.isin(features.view(np.int64), taken).any(axis=1) & toxic[doc]
    segment, at, before = _segments(doc)
    n = len(before)
    rng = np.random.default_rng(seed)
    telling = np.zeros(n, dtype=bool)
    telling[segment[label]] = True
    most = int(TRAIN_SEGMENTS * share)
    order = np.concatenate((rng.permutation(np.flatnonzero(telling))[: most // 2], rng.permutation(np.flatnonzero(~telling))))[:most]
    number = np.full(n, -1)
    number[order] = np.arange(len(order))
    use = number[segment] >= 0
    x, y, s, a = places[use], label[use], number[segment[use]], at[use]
    alone = np.zeros(len(order), dtype=np.int64)
    follows = np.flatnonzero((s[1:] == s[:-1]) & (a[1:] == a[:-1] + 1))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[follows].astype(int), y[follows + 1].astype(int)), 1)
    flat, n_tokens = x.reshape(-1), len(y)
    g_w, g_b, g_s = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(EPOCHS):
        p, both = chain.marginals(x, s, a, alone, pairs=True)
        miss = y - p
        d = np.bincount(flat, weights=np.repeat(miss, x.shape[1]), minlength=size) - 1e-2 * chain.weights
        d_b, d_s = float(miss.sum()), seen - both
        g_w += d * d
        g_b += d_b * d_b
        g_s += d_s * d_s
        chain.weights += 0.5 * d / np.sqrt(g_w)
        chain.bias += 0.5 * d_b / np.sqrt(g_b)
        chain.steps += 0.2 * d_s / np.sqrt(g_s)
        chain.steps -= chain.steps[0, 0]
        if np.abs(miss).sum() < 1e-3 * n_tokens * max(y.mean(), 1e-6):
            break
    chain.weights = chain.weights.astype(np.float32)
    return chain


def train(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Chain:
    """A chain from labelled documents. Without both classes, every score is the share of toxic ones.

    Scores are calibrated on documents that a chain has not seen: each half is
    judged by one learnt from the other half.
    """
    size = 1 << TABLE_BITS
    share = float(np.mean(toxic)) if len(toxic) else 0.0
    blank = Chain(np.zeros(size, dtype=np.float32), 0.0, np.zeros((2, 2)), np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0, 0]))
    if not toxic.any() or toxic.all():
        return blank
    # copies of one document would make their own words look telling
    own = _unlike(texts)
    texts, toxic = [texts[i] for i in own], toxic[own]
    if not toxic.any() or toxic.all():
        return blank
    features, doc = [], []
    for first, w in chunks(pa.array(texts, pa.large_string()), is_word=_IS_WORD, fold_case=True):
        features.append(token_features(w))
        doc.append(w.doc + first)
    features, doc = np.concatenate(features), np.concatenate(doc)
    if not len(doc):
        return blank
    places = _indices(features, doc)
    half = np.zeros(len(texts), dtype=bool)
    for kind in (toxic, ~toxic):
        half[np.flatnonzero(kind)[::2]] = True
    inputs = np.zeros((len(texts), 4))
    for fold in (half, ~half):
        other = _learnt(features, places, doc, toxic, ~fold, seed)
        mine = fold[doc]
        p = other.marginals(places[mine], *_segments(doc[mine]))
        inputs[fold] = _document_inputs(p, doc[mine], len(texts))[fold]
    chain = _learnt(features, places, doc, toxic, np.ones(len(texts), dtype=bool), seed)
    chain.calibration = _logistic(inputs, toxic.astype(float))
    return chain


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
_SPANS = "array<struct<start:bigint,end:bigint,chance:double>>"


def _spans(w: Words, p: np.ndarray, least: float) -> list[list[dict]]:
    """For each text the runs of likely tokens, as character places, with their greatest chance."""
    out: list[list[dict]] = [[] for _ in range(w.n_docs)]
    hot = np.flatnonzero(p >= least)
    for d in np.unique(w.doc[hot]).tolist():
        mine = hot[w.doc[hot] == d]
        base = w.offsets[d]
        chars = np.concatenate(([0], np.cumsum((w.data[base : w.offsets[d + 1]] & 0xC0) != 0x80)))
        for run in np.split(mine, np.flatnonzero(np.diff(mine) != 1) + 1):
            out[d].append({"start": int(chars[w.start[run[0]] - base]), "end": int(chars[w.end[run[-1]] - base]), "chance": float(p[run].max())})
    return out


def _score(model, least: float, inside: tuple[str, str] | None = None):
    """inside: names of id and text in the column row, where that is all there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*model.value)
        for b in batches:
            scores, spans = [np.zeros(0)], []
            texts, ids = (b.column(1), b.column(0)) if inside is None else (b.column("row").field(inside[1]), b.column("row").field(inside[0]))
            for _, w in chunks(texts, is_word=_IS_WORD, fold_case=True):
                p = chain.marginals(_indices(token_features(w), w.doc), *_segments(w.doc)) if len(w.doc) else np.zeros(0)
                x = _document_inputs(p, w.doc, w.n_docs)
                scores.append(1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, chain.calibration), -30, 30))))
                spans += _spans(w, p, least)
            rest = [c for c in b.schema.names if c not in ("doc_id", "text")]
            yield pa.record_batch(
                [ids, pa.array(np.concatenate(scores)), pa.array(spans, _SPAN), *(b.column(c) for c in rest)],
                names=["doc_id", "score", "spans", *rest],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", n: int = TRAIN_DOCS) -> Chain:
    """A chain from labelled, not held-out documents: at most n of each class, of at most TRAIN_CHARS characters.

    An id counts once, with the greatest of its labels and the least of its texts.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, TRAIN_CHARS))
    ids = texts.select("doc_id").join(known, "doc_id").distinct()
    ids = sample_ids(ids.where("y = 1"), n, 1).unionByName(sample_ids(ids.where("y = 0"), n, 1))
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["y"].to_numpy().astype(bool))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, carry: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), spans (start, end, chance) of every document; with carry, also row, a struct of all its columns.

    Null, empty and wordless texts get the score of no toxic tokens and no
    spans. Rows are judged one by one from their text alone; repeated rows get
    equal scores; an empty table gives an empty one; other columns are not read.
    """
    model = shared(docs.sparkSession, chain)
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, score double, spans {_SPANS}"
    if carry:
        rows = docs.select(F.struct("*").alias("row"))
        return rows.mapInArrow(_score(model, least, (id_col, text_col)), f"{fields}, row {rows.schema['row'].dataType.simpleString()}")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_score(model, least), fields)
