import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import packing, queries

from .util import ODD, docs

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(spark):
    tokenizer, ids = Tokenizer.from_file(PATH), packing.TokenIds(open(PATH).read())
    rng = random.Random(7)
    pool = [
        "a", "B", "é", "e\u0301", "'s", "'", "12", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", "İ",
        "ß", "ﬁ", "漢字", "!!", "don't", "\x00", "ᄀ", "ᅡ", "🙂", ".", ",", "%%%", "É", "Σ", "the",
    ]
    for _ in range(1500):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(4)]
        for text, data in zip(texts, ids.of([t.encode() for t in texts]), strict=True):
            assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_fit_rules():
    p = packing.BestFit(10, max_open=2)
    assert p.put(6) == (0, 0) and p.put(7) == (1, 0)
    assert p.put(3) == (1, 7)  # the fullest that holds it
    assert p.put(5) == (2, 0) and p.put(8) == (3, 0)  # third open bin: the fullest, number 3, closes
    assert p.put(2) == (0, 6)
    assert p.put(10) == (4, 0)


class Plain:
    """Best-fit without a bitset: open bins as a list of (free, how lately it was used, number)."""

    def __init__(self, capacity, max_open):
        self.capacity, self.max_open, self.open, self.n, self.time, self.closed = capacity, max_open, [], 0, 0, 0

    def put(self, length):
        fits = [b for b in self.open if b[0] >= length]
        if fits:
            one = min(fits, key=lambda b: (b[0], -b[1]))
            self.open.remove(one)
        else:
            one, self.n = (self.capacity, 0, self.n), self.n + 1
        self.time += 1
        if one[0] > length:
            self.open.append((one[0] - length, self.time, one[2]))
        if len(self.open) > self.max_open:
            self.open.remove(min(self.open, key=lambda b: (b[0], -b[1])))
            self.closed += 1
        return one[2], self.capacity - one[0]


def test_equals_plain_best_fit(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.choice((64, rng.randint(1, 64), rng.randint(1, 20), rng.randint(33, 64))), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    found = {r.doc_id: (r.sequence_id, r.offset) for r in packing.best_fit_pack(frame, 64, max_open=20, lookahead=100).collect()}
    order = [r.doc_id for r in frame.orderBy(F.xxhash64("doc_id", "piece", "ids_crc32")).collect()]
    plain, want = Plain(64, 20), {}
    for run in itertools.batched(order, 100):
        for i in sorted(run, key=lambda i: -rows[i][2]):
            want[i] = plain.put(rows[i][2])
    assert found == want and plain.closed > 100


def test_few_open_bins_fill_sequences(spark):
    lengths = [r.length for r in queries.op10_best_fit_packing(spark, "/root/testdata/sf0.01").collect()]
    for n in (5, 40):
        packer = packing.BestFit(2048)
        places = [packer.put(x) for i in range(0, n * len(lengths), packing.LOOKAHEAD) for x in sorted((lengths * n)[i : i + packing.LOOKAHEAD], reverse=True)]
        assert packer.n_bins <= 1.01 * sum(lengths) * n / 2048 + 1 and len(places) == n * len(lengths) and packer.n_open <= packing.MAX_OPEN


def check(rows, texts, capacity, kind="<u4"):
    """Every document whole and in order; sequences gapless and within capacity. Returns their number."""
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), capacity))
        for r in pieces:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and bytes(r.ids) == np.array(part, kind).tobytes()
            assert r.length == capacity or r is pieces[-1]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_round_trip(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = packing.pack_documents(spark.read.parquet(f"{sf}/documents.parquet"), PATH, 2048, keep_ids=True).collect()
    n = check(found, texts, 2048)
    total = sum(r.length for r in found)
    assert n <= 1.02 * -(-total // 2048) + 1


def test_odd_rows(spark):
    odd = [r for r in ODD if r[0] not in (6, 8, None)]
    assert check(packing.pack_documents(docs(spark, odd), PATH, 64, keep_ids=True).collect(), dict(odd), 64)
    repeated = packing.pack_documents(docs(spark, ODD), PATH, 64).collect()
    assert sum(r.doc_id == 6 for r in repeated) == 2 and any(r.doc_id is None for r in repeated)
    assert packing.pack_documents(docs(spark, []), PATH, 64).collect() == []


def test_ids_of_two_bytes(spark):
    import pytest

    odd = [(1, "one two three"), (2, None), (3, "x " * 300)]
    assert check(packing.pack_documents(docs(spark, odd), PATH, 64, keep_ids=True, id_bytes=2).collect(), dict(odd), 64, "<u2")
    with pytest.raises(ValueError, match="does not fit"):
        packing._narrow((70_000).to_bytes(4, "little"))
