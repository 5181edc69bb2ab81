"""Quality rules as a bitmask ledger.

Every text is measured once. Each rule's failure is one bit of ``failed``, kept
beside the measurements; a policy is a versioned set of bits, so changing it,
or asking what a rule costs, never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .wordhash import Words, chunks

REPEAT_WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


#: Bits are never reused; a rule that changes gets a new one.
RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "n_symbols * 5 > n_words"),
    Rule(3, "repeated_lines", "n_dup_lines * 2 > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "exclamations", "n_exclaims * 4 > n_words"),
)
BASE = ("few_words", "repeated_passages")
#: Version to the rules that a kept text must pass.
POLICIES: dict[int, tuple[str, ...]] = {1: BASE, 2: tuple(r.name for r in RULES)}
LATEST = 2


def mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeat_words(words: Words) -> np.ndarray:
    """Words in windows that their text holds more than once."""
    first, h = words.windows(REPEAT_WINDOW)
    if not len(first):
        return np.zeros(words.n_docs, dtype=np.int64)
    doc = words.doc[first]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(first), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words.hash) + 1, dtype=np.int64)
    at = first[twice]
    np.add.at(step, at, 1)
    np.add.at(step, at + REPEAT_WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=words.n_docs)


def _lines(text: bytes) -> tuple[int, int]:
    """(lines that hold a word, those equal to an earlier line)."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines), len(lines) - len(set(lines))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        columns: list[list] = [[] for _ in _MEASURES]
        for _, w in chunks(b.column(1)):
            n_words = w.counts()
            in_word = np.zeros(len(w.data) + 1, dtype=np.int8)
            in_word[w.start] += 1
            in_word[w.end] -= 1
            inside = np.cumsum(in_word[:-1]) > 0
            chars = _per_text(inside & ((w.data & 0xC0) != 0x80), w.offsets)
            lines = np.array([_lines(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()) for i in range(w.n_docs)], dtype=np.int64).reshape(-1, 2)
            found = (n_words, chars, _per_text(_SYMBOL[w.data], w.offsets), lines[:, 1], _repeat_words(w), lines[:, 0], _per_text(w.data == 33, w.offsets))
            for c, x in zip(columns, found, strict=True):
                c.append(x)
        arrays = [pa.array(np.concatenate(c) if c else np.zeros(0), pa.int64()) for c in columns]
        yield pa.record_batch([b.column(0), *arrays], names=["doc_id", *_MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements, and failed (long): bit b is set if the rule of bit b fails.

    Words are `[^\\x20\\x09-\\x0D]+`; word_chars: code points in words; n_symbols:
    characters of `[#*$%&|<>]`; n_lines: \\n-split lines with a word, of which
    n_dup_lines equal an earlier one; n_repeat_words: words in five-word windows
    that the text holds more than once. Null, empty and blank texts measure 0 in
    all and fail few_words only. Each row is judged alone, so repeated rows and
    ids come back as they are; an empty table gives an empty one; other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    measured = texts.mapInArrow(_measure, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in _MEASURES)]))
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")) for r in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def passes(version: int, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0


def policies(rows: DataFrame) -> DataFrame:
    """rows with kept_v1, kept_v2, ...: the verdict of every version of the policy, from the bits alone."""
    return rows.select("*", *(passes(v).alias(f"kept_v{v}") for v in POLICIES))


def ablations(rows: DataFrame, version: int = LATEST) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (rows that this rule alone rejects), n_kept and n_kept_without.

    One aggregation over the ledger's bits; an empty ledger gives zeros.
    """
    whole = mask(POLICIES[version])
    rules = [r for r in RULES if r.name in POLICIES[version]]
    masked = F.col("failed").bitwiseAND(F.lit(whole).cast("long"))
    aggs = [F.count_if(masked == 0).alias("n_kept")]
    for r in rules:
        one = F.lit(1 << r.bit).cast("long")
        aggs += [F.count_if(masked.bitwiseAND(one) != 0).alias(f"f{r.bit}"), F.count_if(masked == one).alias(f"o{r.bit}")]
    parts = [
        F.struct(
            F.lit(version).alias("version"), F.lit(r.name).alias("rule"), F.col(f"f{r.bit}").alias("n_failed"), F.col(f"o{r.bit}").alias("n_only"),
            F.col("n_kept"), (F.col("n_kept") + F.col(f"o{r.bit}")).alias("n_kept_without"),
        ) for r in rules
    ]
    return rows.agg(*aggs).select(F.inline(F.array(*parts)))
