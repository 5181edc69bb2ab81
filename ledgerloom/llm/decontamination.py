"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items and documents are normalised alike: A-Z lower-cased, words
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (digits, letters a to z and everything beyond
ASCII). A passage is a window of 13 consecutive item words, or the whole item
where it is shorter. Matched words are mapped back to places in the original
text.

The automaton reads word numbers, of two bytes or more. Its patterns are short
items whole, and of longer ones a block of ``BLOCK`` words at every (13 - BLOCK + 1)-th place:
each window holds one such block, and all blocks together are shorter than the
items, so that the automaton grows with their text alone. One scan of a document
finds the blocks; only windows around a block are looked up, by hash, in the
items' windows, and compared word by word.
"""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Iterator
from itertools import repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .wordhash import mix

WINDOW = 13
#: Words of a pattern of the automaton, where windows are as long.
BLOCK = 4
#: Bytes of normalised item text in one automaton (about 1 GB of memory a worker at most); more are scanned in further passes.
AUTOMATON_BYTES = 48 << 20
#: Bytes of text that are split into words at once.
CHUNK = 1 << 20

_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TABLE = bytes(b if b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_U = np.uint64


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """Normalised words of UTF-8 text, some at a time; all separators are ASCII."""
    data, at = text.translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) + 1 or len(data)
        yield data[at:end].split()
        at = end


class Automaton:
    """Windows of items (item_id, normalised text), with the items that hold each."""

    def __init__(self, items: list[tuple[int, bytes]], size: int = WINDOW):
        import ahocorasick

        self.size, self.block = size, min(BLOCK, (size + 1) // 2)
        self.step = size - self.block + 1
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[bytes, set[int]] = {}
        for item_id, text in items:
            if text:
                owners.setdefault(text, set()).add(item_id)
        self.owners: list[tuple[int, ...]] = []
        short: list[tuple[np.ndarray, tuple[int, ...]]] = []
        long_, at, n = [], [], 0
        for text, ids in owners.items():
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in text.split()], dtype=np.int32)
            if len(words) < size:
                short.append((words, tuple(ids)))
                continue
            self.owners.append(tuple(ids))
            at.append(n + np.arange(0, len(words) - self.block + 1, self.step, dtype=np.int32))
            long_ += [words, np.zeros(1, dtype=np.int32)]
            n += len(words) + 1
        # nodes find their next letter in a list, so letters are bytes, and the high ones come first
        self.width = max(2, (len(self.vocabulary).bit_length() + 7) // 8)
        flat = np.concatenate(long_) if long_ else np.zeros(0, dtype=np.int32)
        short_ = {self._letters(words): (len(words), ids) for words, ids in short}
        self.found = ahocorasick.Automaton()
        if at:
            for row in np.unique(flat[np.concatenate(at)[:, None] + np.arange(self.block)], axis=0):
                letters = self._letters(row)
                self.found.add_word(letters, (self.block, short_.pop(letters, (0, ()))[1], True))
        for letters, (n, ids) in short_.items():
            self.found.add_word(letters, (n, ids, False))
        self.empty = not len(self.found)
        if not self.empty:
            self.found.make_automaton()
        self._index(flat)

    def _letters(self, words: np.ndarray) -> str:
        return words.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - self.width :].tobytes().decode("latin-1")

    def _hashed(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.full(len(at), self.seed, dtype=_U)
        for i in range(self.size):
            h = mix(h * _U(0xD6E8FEB86659FD93) + words[at + i].astype(_U))
        return h

    def _index(self, flat: np.ndarray) -> None:
        """Different windows in order of their hash, each with the items of all texts that hold it."""
        ends = np.flatnonzero(flat == 0).astype(np.int32)
        start = np.flatnonzero(flat != 0).astype(np.int32)
        item = np.searchsorted(ends, start).astype(np.int32)
        ok = start + self.size <= ends[item] if len(ends) else np.zeros(0, dtype=bool)
        start, item = start[ok], item[ok]
        self.flat = flat
        for self.seed in range(1, 100):
            h = self._hashed(flat, start)
            order = np.argsort(h, kind="stable").astype(np.int32)
            h = h[order]
            at, again = start[order], np.flatnonzero(h[1:] == h[:-1])
            if all((flat[at[again] + i] == flat[at[again + 1] + i]).all() for i in range(self.size)):
                break
        else:
            raise RuntimeError("different windows share hashes under all seeds")
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))[: len(h)])
        self.hashes, self.places, self.items = h[first], at[first], item[order]
        self.bounds = np.append(first, len(h)).astype(np.int32)

    def _windows(self, words: np.ndarray, blocks: list[int]) -> tuple[np.ndarray, set[int]]:
        """(first words of windows around blocks that items hold, those items)."""
        hit, found = [], set()
        around = np.arange(self.step)
        for i in range(0, len(blocks), 1 << 14):
            at = np.unique(np.array(blocks[i : i + (1 << 14)])[:, None] - around)
            at = at[(at >= 0) & (at + self.size <= len(words))]
            h = self._hashed(words, at)
            place = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            same = self.hashes[place] == h
            at, place = at[same], place[same]
            for k in range(self.size):
                same = words[at + k] == self.flat[self.places[place] + k]
                at, place = at[same], place[same]
            hit.append(at)
            place = np.unique(place)
            low, n = self.bounds[place].astype(np.int64), (self.bounds[place + 1] - self.bounds[place]).astype(np.int64)
            entries = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.update(i for x in np.unique(self.items[entries]).tolist() for i in self.owners[x])
        return np.unique(np.concatenate(hit)), found

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """(words, merged word intervals that any window covers, items that hold one)."""
        get, parts, n = self.vocabulary.get, [], 0
        spans, blocks, found, before = [], [], set(), np.zeros(0, dtype=np.int32)
        for words in words_of(text):
            if self.empty:
                n += len(words)
                continue
            numbers = np.array(list(map(get, words, repeat(0))), dtype=np.int32)
            some, base = np.concatenate((before, numbers)), n - len(before)
            for end, (size, items, is_block) in self.found.iter(self._letters(some)):
                end, inside = divmod(end + 1, self.width)
                if inside:  # not at the edges of words
                    continue
                first = base + end - size
                if items:
                    spans.append((first, first + size))
                    found.update(items)
                if is_block:
                    blocks.append(first)
            parts.append(numbers)
            n += len(words)
            before = some[-self.size :]
        if blocks:
            at, more = self._windows(np.concatenate(parts), blocks)
            spans += [(i, i + self.size) for i in at.tolist()]
            found |= more
        return n, merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places (start, end) in the text, in characters, of word intervals."""
    if not spans:
        return []
    sign = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    table = np.ones(0x80, dtype=bool)
    table[[b for b in range(0x80) if _TABLE[b] == 32]] = False
    word = np.where(sign < 0x80, table[np.minimum(sign, 0x7F)], True)
    edge = np.diff(np.concatenate(([0], word.astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(start[a]), int(end[b - 1])) for a, b in spans]


def _automaton(items: list[tuple[int, bytes]], size: int, token: str) -> Automaton:
    """The last one built is kept in the worker process from task to task."""
    kept = sys.modules.setdefault("_ledgerloom_automaton", ModuleType("_ledgerloom_automaton")).__dict__
    if token not in kept:
        for old in [k for k in kept if not k.startswith("__")]:
            del kept[old]
        kept[token] = Automaton(items, size)
    return kept[token]


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """Normalised text of an item, in parts of about CHUNK bytes that share size - 1 words."""
    held: list[bytes] = []
    whole = True
    for some in words_of(text):
        held += some
        if len(held) >= size:
            yield b" ".join(held)
            held, whole = held[len(held) - size + 1 :], False
    if whole and held:
        yield b" ".join(held)


def _normalised(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, p) for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) for p in parts_of(t, size)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["item_id", "words"])

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPANS = "array<struct<start:bigint,end:bigint>>"
#: Hits so far: intervals of words, and items.
_HITS = f"n_words long, word_spans {_SPANS}, items array<bigint>"


def _text_of(b: pa.RecordBatch, inside: str | None) -> pa.Array:
    return b.column("text") if inside is None else b.column("row").field(inside)


def _scan(items, size: int, first: bool, inside: str | None):
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items.value, size, token)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, spans, found = [], [], []
                texts = _text_of(part, inside)
                before = [([], [])] * len(texts) if first else zip(part.column("word_spans").to_pylist(), part.column("items").to_pylist(), strict=True)
                for text, (old, ids) in zip(texts.cast(pa.binary()).to_pylist(), before, strict=True):
                    n_words, s, hit = automaton.scan(text or b"")
                    n.append(n_words)
                    spans.append([{"start": a, "end": e} for a, e in merged(s + [(x["start"], x["end"]) for x in old])])
                    found.append(sorted(hit | set(ids)))
                extra = [c for c in part.schema.names if c not in ("n_words", "word_spans", "items")]
                yield pa.record_batch(
                    [*(part.column(c) for c in extra), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(found, pa.list_(pa.int64()))],
                    names=[*extra, "n_words", "word_spans", "items"],
                )

    return run


def _places(inside: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[(x["start"], x["end"]) for x in s] for s in b.column("word_spans").to_pylist()]
            texts = _text_of(b, inside)
            places = [[{"start": a, "end": e} for a, e in original_spans(texts[i].as_py() or "", s)] if s else [] for i, s in enumerate(spans)]
            n_hit = [sum(e - a for a, e in s) for s in spans]
            items = b.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(sorted(map(str, i))).encode()).hexdigest() for i in items]
            n = b.column("n_words").to_pylist()
            bad = [h > 0 and 20 * h >= w for h, w in zip(n_hit, n, strict=True)]
            extra = [c for c in b.schema.names if c not in ("n_words", "word_spans", "items")]
            yield pa.record_batch(
                [
                    *(b.column(c) for c in extra), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                    pa.array(sha), pa.array(bad), b.column("items"), pa.array(places, _SPAN),
                ],
                names=[*extra, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return run


def _chained(first, then):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(first(batches))

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = WINDOW, limit: int = AUTOMATON_BYTES, carry: bool = False, scratch: Scratch | None = None,
) -> DataFrame:
    """One row per document: doc_id, text, n_words, n_hit, n_items, items_sha256, contaminated, items, spans.

    With carry, row, a struct of all the document's columns, in place of text.

    A word inside any occurrence of a window is hit; items: ids with occurring
    windows; spans: character places of hit passages in the original text;
    contaminated: at least one word in twenty is hit.

    Null, empty and wordless texts have no words and are clean. Items without an
    id or without words have no windows; rows with a repeated item id are one
    item. Repeated documents each get their row. Without any item all documents
    are clean. Other columns are not read.

    Item texts go to every worker only in shares of about ``limit`` bytes, whose
    size is checked first; only benchmarks beyond that take another pass over the
    texts for each further share. Items of more than CHUNK bytes come in parts, so
    that shares stay even. Ids of items are integers.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontamination")
    items = benchmark.select(
        F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"),
    ).where("item_id is not null and text is not null")
    items = scratch.save(items.mapInArrow(_normalised(size), "item_id long, words binary").distinct(), "items")
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    passes = -(-total // limit) or 1
    # with carry the text travels inside of row only
    texts = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    out = docs.select(F.col(id_col).alias("doc_id"), F.struct("*").alias("row")) if carry else docs.select(*texts)
    inside = text_col if carry else None
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema)
    for n in range(passes):
        share = [(r.item_id, bytes(r.words)) for r in items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == n).collect()]
        scan = _scan(spark.sparkContext.broadcast(sorted(share)), size, n == 0, inside)
        if n + 1 < passes:
            out = scratch.save(out.mapInArrow(scan, f"{kept}, {_HITS}"), f"pass-{n}")
    # the last pass and the places come from one worker
    return out.mapInArrow(
        _chained(scan, _places(inside)),
        f"{kept}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<bigint>, spans {_SPANS}",
    )
