"""Cross-site removal of boilerplate lines.

Lines are reduced to hashes once and counted by hash. Lines that are frequent
enough get one HyperLogLog sketch of their sites each, merged by aggregation;
estimates far from the threshold decide, and lines near it are counted exactly.
A line on enough distinct sites is wide.

A document copied from site to site makes all its lines wide, though none is
boilerplate. So a wide line is cut only if enough sites still hold it when
copies are left out: a document counts for its wide lines if most of the rest of
it is its own, in pieces between punctuation. Of documents with wide lines that
share a piece, the one of the smallest id owns it. A group of copies, exact or edited, then counts
about once, and can neither make a line boilerplate nor keep one.

Template pages have little of their own, or nothing. What tells them from copies is
that a copied line brings others along: its mate in a text is the text's other wide
line of the least MD5, and the lines of a copied document mostly have the same mate in all
copies. A wide line that has no mate in three of five of its texts stands alone; it is no
part of a copied document, and all its texts count for it, own words or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh

MIN_SITES = 5
#: Lines of fewer characters need SHORT_SITES sites: natural sentences are often as short.
SHORT = 20
SHORT_SITES = 2 * MIN_SITES
#: Estimates within this share of a threshold are counted exactly: six standard errors of a sketch of 2^12 registers.
NEAR = 0.1
#: Share (own, whole) of its rest that a text must own to count; edited copies of a text own up to about two thirds.
OWN = (3, 4)
#: Share of its texts in which a copied line has one and the same mate.
MATES = (3, 5)
#: What ends a piece of text.
PIECE_ENDS = r"[\n.,;:!?。、，！？]+"
_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(text: Column) -> Column:
    """96 bits of hash."""
    return F.struct(F.xxhash64(text).alias("h"), F.hash(text).alias("g"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_chars: int = 1) -> DataFrame:
    """(doc_id, t, k, short, site) for each different line of a document with min_chars characters or more, but blank ones.

    t and k: keys of the text and of the line; site: hash, or null.
    """
    text, site = F.col(text_col).cast("string"), F.col(site_col).cast("string")
    rows = docs.where(F.length(text) > 0).select(
        F.col(id_col).alias("doc_id"), _key(text).alias("t"), F.when(site.isNotNull(), F.xxhash64(site)).alias("site"),
        F.explode(F.array_distinct(_lines(text))).alias("line"),
    )
    rows = rows.where((F.length("line") >= min_chars) & (F.trim(F.col("line"), F.lit(_BLANK)) != ""))
    return rows.select("doc_id", "t", _key(F.col("line")).alias("k"), (F.length("line") < SHORT).alias("short"), "site")


def _need(min_sites: int) -> Column:
    return F.when(F.col("short"), F.lit(max(min_sites, SHORT_SITES))).otherwise(F.lit(min_sites))


def sketched(pairs: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES, near: float = NEAR, name: str = "sites") -> DataFrame:
    """(k, short, sites, sure) of lines of (k, short, site) whose estimated sites reach, or come near, what they need."""
    need = _need(min_sites)
    frequent = pairs.groupBy("k", "short").agg(F.count("site").alias("n")).where(F.col("n") >= need).select("k")
    found = pairs.join(scratch.side(frequent, f"{name}-frequent"), "k")
    found = found.groupBy("k", "short").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site")).alias("sites"))
    found = scratch.save(found.withColumn("sure", F.col("sites") >= need * (1 + near)).where(F.col("sites") >= need * (1 - near)), f"{name}-sketched")
    scratch.drop(f"{name}-frequent")
    return found


def spread(pairs: DataFrame, min_sites: int, near: float, scratch: Scratch, name: str) -> DataFrame:
    """(k, short) of lines of (k, short, site) that stand on as many distinct sites as they need."""
    found = sketched(pairs, scratch, min_sites, near, name)
    close = pairs.join(scratch.side(found.where("not sure").select("k"), f"{name}-close"), "k", "left_semi")
    exact = close.select("k", "short", "site").distinct().groupBy("k", "short").agg(F.count("site").alias("sites"))
    exact = exact.where(F.col("sites") >= _need(min_sites)).select("k", "short")
    found = scratch.side(found.where("sure").select("k", "short").unionByName(exact), name)
    scratch.drop(f"{name}-sketched", f"{name}-close")
    return found


def _cut(text: Column, keys: Column) -> Column:
    """Lines of a text but those with one of these keys."""
    return F.filter(_lines(text), lambda x: ~F.array_contains(keys, _key(x)))


def _rests(docs: DataFrame, holders: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(t, doc_id, pieces, wide) of the holders (t, first (doc_id, site), keys of wide lines): pieces of their rest, and wide lines (k, o: by MD5)."""
    firsts = scratch.side(holders.select("t", F.col("first.doc_id").alias("doc_id"), "keys").where("doc_id is not null"), "firsts")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _key(text).alias("t")).join(firsts, ["t", "doc_id"])
    pieces = F.transform(F.split(F.array_join(_cut(F.col("text"), F.col("keys")), "\n"), PIECE_ENDS), F.trim)
    pieces = F.transform(
        F.filter(F.array_distinct(pieces), lambda x: x != ""),
        lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.length(x).alias("n")),
    )
    wide = F.filter(F.array_distinct(_lines(F.col("text"))), lambda x: F.array_contains(F.col("keys"), _key(x)))
    wide = F.transform(wide, lambda x: F.struct(_key(x).alias("k"), F.substring(F.md5(x), 1, 16).alias("o")))
    rests = scratch.save(texts.select("t", "doc_id", pieces.alias("pieces"), wide.alias("wide")), "rests")
    scratch.drop("firsts")
    return rests


def independent(rests: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id) of documents that own most of their rest."""
    owner = rests.select("doc_id", F.inline("pieces")).groupBy("h", "g", "n").agg(F.min("doc_id").alias("doc_id"))
    own = owner.groupBy("doc_id").agg(F.sum("n").alias("own"))
    # rows of one id and text say the same; different texts of one id are judged together
    weight = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    whole = rests.groupBy("doc_id", "t").agg(F.max(weight).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("whole"))
    found = whole.join(own, "doc_id").where(F.col("own") * OWN[1] >= F.col("whole") * OWN[0]).select("doc_id")
    return scratch.side(found, "independent")


def alone(rests: DataFrame, scratch: Scratch) -> DataFrame:
    """(k) of wide lines without a mate in MATES of their texts."""
    least = lambda wide: F.array_min(F.transform(wide, lambda x: x["o"]))
    texts = rests.groupBy("t").agg(F.any_value("wide").alias("wide")).withColumn("first", least(F.col("wide")))
    texts = texts.withColumn("second", least(F.filter("wide", lambda x: x["o"] != F.col("first"))))
    mates = texts.select("first", "second", F.inline("wide")).withColumn("mate", F.when(F.col("o") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    counts = mates.groupBy("k", "mate").agg(F.count("*").alias("n"))
    most = F.coalesce(F.max(F.when(F.col("mate").isNotNull(), F.col("n"))), F.lit(0))
    return scratch.side(counts.groupBy("k").agg(most.alias("most"), F.sum("n").alias("n")).where(F.col("most") * MATES[1] < F.col("n") * MATES[0]).select("k"), "alone")


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_chars: int = 1,
    near: float = NEAR, scratch: Scratch | None = None,
) -> DataFrame:
    """docs with boilerplate lines cut out of the text, and n_removed (lines cut).

    All rows and columns stay; a column of docs named n_removed gives way. Lines
    are \\n-split; blank ones, and those of fewer than min_chars characters, are
    never cut. A null text stays null and an empty one empty; a null site is no
    site. Equal texts are cleaned alike and count once, with their first row in
    order of id and site, so repeated rows change nothing; texts of which no row
    has an id are cleaned but count for no line. An empty table gives an empty
    one. A line goes if min_sites sites (SHORT_SITES at least for lines under SHORT
    characters) hold it, and still do with copies left out, or if it stands alone.
    """
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.save(line_table(docs, id_col, text_col, site_col, min_chars), "lines")
    wide = spread(lines, min_sites, near, scratch, "wide")
    holding = lines.join(wide.select("k"), "k", "left_semi").groupBy("t")
    holders = holding.agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "site"))).alias("first"), F.collect_set(F.struct("k", "short")).alias("ks"))
    holders = scratch.save(holders.select("t", "first", "ks", F.col("ks.k").alias("keys")), "holders")
    scratch.drop("lines")
    counting = holders.select(F.col("first.doc_id").alias("doc_id"), F.col("first.site").alias("site"), F.explode("ks").alias("x"))
    rests = _rests(docs, holders, id_col, text_col, scratch)
    counting = counting.select("doc_id", "x.k", "x.short", "site").join(independent(rests, scratch).withColumn("own", F.lit(True)), "doc_id", "left")
    counting = counting.join(alone(rests, scratch).withColumn("lonely", F.lit(True)), "k", "left").where("own OR lonely").select("k", "short", "site")
    counting = scratch.save(counting, "counting")
    scratch.drop("rests")
    cut = spread(counting, min_sites, near, scratch, "cut")
    hits = holders.select("t", F.explode("keys").alias("k")).join(cut.select("k"), "k", "left_semi")
    hits = hits.groupBy("t").agg(F.collect_list("k").alias("keys"))
    t, keys, left = (fresh(docs, c) for c in ("t", "keys", "left"))
    hits = scratch.side(hits.select(F.col("t").alias(t), F.col("keys").alias(keys)), "hits")
    text = F.col(text_col).cast("string")
    rows = docs.drop("n_removed").withColumn(t, _key(text)).join(hits, t, "left").withColumn(left, F.when(F.col(keys).isNotNull(), _cut(text, F.col(keys))))
    n_removed = F.when(F.col(left).isNotNull(), (F.size(_lines(text)) - F.size(left)).cast("long")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("n_removed", n_removed).withColumn(text_col, F.coalesce(F.array_join(left, "\n"), F.col(text_col)))
    return rows.select(*(c for c in docs.columns if c != "n_removed"), "n_removed")
