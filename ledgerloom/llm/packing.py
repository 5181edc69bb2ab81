"""Packing token sequences by bounded-space online best-fit.

A task packs its share of the pieces as they come: a piece goes to the fullest
open bin that holds it, found in a bitset whose bit f says that some open bin
has f tokens free. At most ``max_open`` bins are open; beyond that, the fullest
closes first. Pieces come in order of a hash, so a rerun after a lost executor
gives the same bins, and the packer looks ``LOOKAHEAD`` of them ahead: it takes
the longest of those first.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from itertools import pairwise
from os.path import commonprefix
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

MAX_OPEN = 256
#: Pieces that the packer holds and takes longest first.
LOOKAHEAD = 1000
#: Pieces that one task packs; a task leaves about one bin partly filled.
PIECES_PER_TASK = 20_000
#: Parts of text whose ids a worker process keeps, of about 200 bytes each; when full, short ones stay, which come most often.
CACHED_PARTS = 1_200_000
KEPT_LENGTH = 7


class BestFit:
    """Online best-fit with a fixed number of open bins of one capacity."""

    def __init__(self, capacity: int, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.free_bits, self.n_open, self.n_bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of the next piece; 0 < length <= capacity."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.free_bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.max_open:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
        return bin_, self.capacity - free


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


#: Signs that may end a part: ASCII ones but the apostrophe, which some tokens join to letters.
_TAIL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b != 39)


class TokenIds:
    """Token ids, as little-endian 32-bit bytes, of a text's parts between ASCII white space.

    For a tokenizer that lower-cases, drops white space, and splits runs of
    letters from runs of other signs, with word ends marked by ``</w>``: no
    token spans two such runs, so a text's ids are its parts' ids in order.
    Parts not seen before are encoded many at a time. The cache drops
    its longer keys when it is full.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # what all special tokens begin with; parts that hold it are encoded whole
        self.mark = commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()] or ["\x00"]).encode()
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, part: bytes) -> bytes:
        return np.array(self.tokenizer.encode(part.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of parts that consist of letters alone."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words):
            return [self._encode(w) for w in words]
        data, places = ids.tobytes(), (at * 4).tolist()
        return [data[i:j] for i, j in pairwise([0, *places])]

    def learn(self, parts: set[bytes]) -> None:
        cache, cut, words = self.cache, [], set()
        for part in parts:
            word = part.translate(_LOWER).rstrip(_TAIL)
            # a tail is cut from a letter or digit only: other signs would run on into it
            if word not in words:
                known = word in cache and word != part
                if known and word[-1:].isalnum():
                    pass
                elif self.mark in part or len(part) > 64 or not _letters(word):
                    cache[part] = self._encode(part)
                    continue
                elif not known:
                    words.add(word)
            cut.append((part, word))
        found = list(words)
        for i in range(0, len(found), 5000):
            some = found[i : i + 5000]
            cache.update(zip(some, self._words(some), strict=True))
        for part, word in cut:
            if len(part) != len(word):
                tail = part[len(word) :]
                if tail not in cache:
                    cache[tail] = self._encode(tail)
                cache[part] = cache[word] + cache[tail]
            elif part != word:
                cache[part] = cache[word]

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(texts), 16):
            parts = [t.split() for t in texts[i : i + 16]]
            found = [list(map(self.cache.get, p)) for p in parts]
            holes = [[n for n, x in enumerate(f) if x is None] if None in f else [] for f in found]
            missing = {p[n] for p, hs in zip(parts, holes, strict=True) for n in hs}
            if missing:
                if len(self.cache) + len(missing) > CACHED_PARTS:
                    short = {k: v for k, v in self.cache.items() if len(k) <= KEPT_LENGTH}
                    self.cache = short if 2 * len(short) < CACHED_PARTS else {}
                self.learn(missing)
            for p, f, hs in zip(parts, found, holes, strict=True):
                for n in hs:
                    f[n] = self.cache[p[n]]
                yield b"".join(f)


def _letters(word: bytes) -> bool:
    """Whether a lower-cased part is one run of letters, ending in a Latin one, for the tokenizer too."""
    if word.isalpha():
        return True
    text = word.decode("utf-8")
    return text.isalpha() and text.lower().isalpha() and text[-1] < "\u0250"


def _token_ids(model: str) -> TokenIds:
    """One for each worker process and model, kept from task to task."""
    kept = sys.modules.setdefault("_ledgerloom_token_ids", ModuleType("_ledgerloom_token_ids")).__dict__
    key = hash(model)
    if key not in kept:
        kept[key] = TokenIds(model)
    return kept[key]


def _forget_token_ids() -> None:
    """Let go of what this worker process kept for tokenizing."""
    kept = sys.modules.get("_ledgerloom_token_ids")
    if kept is not None:
        for key in [k for k, v in vars(kept).items() if isinstance(k, int)]:
            del vars(kept)[key]


def _narrow(ids: bytes) -> bytes:
    """The same ids with 16 bits each."""
    wide = np.frombuffer(ids, "<u4")
    if len(wide) and wide.max() > 0xFFFF:
        raise ValueError(f"the id {wide.max()} does not fit into two bytes")
    return wide.astype("<u2").tobytes()


def _pieces(model: str, max_length: int, end_id: int, keep_ids: bool, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _token_ids(model.value)
        end, step = end_id.to_bytes(4, "little"), 4 * max_length
        shown = (_narrow if id_bytes == 2 else bytes) if keep_ids else (lambda piece: None)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = ([], [], [], [], [], [])
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                for doc_id, data in zip(part.column(0).to_pylist(), ids.of(texts), strict=True):
                    data += end
                    for n, at in enumerate(range(0, len(data), step)):
                        piece = data[at : at + step]
                        for column, value in zip(out, (doc_id, n, at // 4, len(piece) // 4, zlib.crc32(piece), shown(piece)), strict=True):
                            column.append(value)
                columns = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if keep_ids else 5
                yield pa.record_batch(columns[:n], names=names[:n])

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, max_length: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, id_bytes: int = 4,
) -> DataFrame:
    """Pieces of at most max_length tokens of each document's ids and end_id.

    ``tokenizer`` is the path of a tokenizer file on the driver; it drops white
    space, as BPE with word ends does. With keep_ids, column ids holds the
    piece's ids as little-endian unsigned integers of id_bytes (4, or 2 where the
    vocabulary has no larger ids; any that does not fit is an error).
    """
    if id_bytes not in (2, 4):
        raise ValueError("id_bytes must be 2 or 4")
    with open(tokenizer, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_pieces(model, max_length, end_id, keep_ids, id_bytes), schema)


def _runs(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The same rows, n at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        while sum(x.num_rows for x in held) >= n:
            whole = pa.concat_batches(held)
            yield whole.slice(0, n)
            held = [whole.slice(n)]
    if any(x.num_rows for x in held):
        yield pa.concat_batches(held)


def _fit(capacity: int, max_open: int, lookahead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_token_ids()  # all is tokenized; the memory is better spent here
        packer, first = BestFit(capacity, max_open), TaskContext.get().partitionId() << 32
        for b in _runs(batches, lookahead):
            lengths = b.column("length").to_numpy()
            places = np.empty((len(lengths), 2), dtype=np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                places[i] = packer.put(int(lengths[i]))
            yield pa.record_batch([*b.columns, pa.array(first + places[:, 0]), pa.array(places[:, 1])], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def best_fit_pack(pieces: DataFrame, capacity: int, max_open: int = MAX_OPEN, per_task: int = PIECES_PER_TASK, lookahead: int = LOOKAHEAD) -> DataFrame:
    """pieces with sequence_id and offset; no sequence holds more than capacity tokens.

    Pieces are dealt out evenly, whatever their document, so a document of many
    pieces or repeated rows crowd no task.
    """
    tasks = max(1, -(-pieces.count() // per_task))
    dealt = pieces.repartition(tasks).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32", "length")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(_fit(capacity, max_open, lookahead), f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
    max_open: int = MAX_OPEN, scratch: Scratch | None = None, id_bytes: int = 4,
) -> DataFrame:
    """Whole documents packed into sequences of at most ``capacity`` tokens.

    Returns, for each piece: doc_id, piece (from 0), start, length, ids_crc32,
    [ids,] sequence_id, offset. Only documents longer than capacity are cut,
    into pieces of that many tokens and one rest. Null, empty and blank texts
    give the one token end_id. Rows with a null or repeated id are packed as
    documents of their own. An empty table gives an empty one; other columns are
    not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids, id_bytes), "pieces")
    return best_fit_pack(pieces, capacity, max_open)
