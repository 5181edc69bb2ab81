"""Master data: parties, ledgers and stock items, from files, XML answers or a cached snapshot."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Words that make a ledger a party.
PARTY_WORDS = "debtor|creditor|customer|vendor"
RECORD = "array<struct<name:string,code:string,aliases:array<string>>>"
CACHE_SECONDS = 300
#: How long snapshots that newer ones replaced stay for those who still read them.
KEEP_SECONDS = 86_400


def is_party(name: Column) -> Column:
    return F.lower(name).rlike(PARTY_WORDS)


def split_aliases(c: Column) -> Column:
    """Comma-separated names, trimmed, without empty ones."""
    return F.array_remove(F.transform(F.split(c, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """(entity_type, pos, name, code, aliases) of a JSON file with parties, ledgers and stock_items."""
    rows = spark.read.schema(f"parties {RECORD}, ledgers {RECORD}, stock_items {RECORD}").option("multiLine", True).json(path)
    kinds = (("party", "parties"), ("ledger", "ledgers"), ("stock_item", "stock_items"))
    parts = [rows.select(F.lit(k).alias("entity_type"), F.posexplode(c).alias("pos", "r")) for k, c in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(
        "entity_type", "pos", "r.name", "r.code", F.coalesce("r.aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def _capitals(xml: Column) -> Column:
    """Tags of either spelling as one: tags that differ in case alone would be one column twice."""
    return F.regexp_replace(F.regexp_replace(xml, r"<(/?)Name>", "<$1NAME>"), r"<(/?)MasterId>", "<$1MASTERID>")


ROW = "NAME:string,_NAME:string,MASTERID:string,ALIASES:string"


def _records(rows: DataFrame, entity_type: str) -> DataFrame:
    """Records of rows (pos, r): trimmed names and codes, aliases split; nameless ones are dropped."""
    name, code = F.trim(F.coalesce("r.NAME", "r._NAME")), F.trim("r.MASTERID")
    return rows.select(
        F.lit(entity_type).alias("entity_type"), "pos", name.alias("name"), F.nullif(code, F.lit("")).alias("code"),
        F.coalesce(split_aliases(F.col("r.ALIASES")), F.array().cast("array<string>")).alias("aliases"),
    ).where("name <> ''")


def read_collection(answers: DataFrame, entity_type: str, row_tag: str, body: str = "body") -> DataFrame:
    """Records of XML answers: names and codes by either spelling, aliases split; nameless ones are dropped."""
    parsed = F.from_xml(_capitals(F.col(body)), f"COLLECTION struct<{row_tag}:array<struct<{ROW}>>>", {"mode": "PERMISSIVE"})
    return _records(answers.select(F.posexplode(parsed["COLLECTION"][row_tag]).alias("pos", "r")), entity_type)


def read_collection_files(spark: SparkSession, path: str, entity_type: str, row_tag: str) -> DataFrame:
    """As `read_collection`, of XML files of any size, read in parts by many tasks.

    Records end at their closing tags, where Spark splits files into lines. pos is the
    place of a record: file, start of the part, and order within it, so the first
    of equal names is the same as if a file were read at once. Attribute values must not hold >.
    """
    end = f"</{row_tag}>"
    lines = spark.read.option("lineSep", end).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"), "value",
    )
    opening = rf"(?s)<{row_tag}(?=[\s/>])(?:[^>]*/>|.*)"
    rows = lines.select("file", "part", "line", F.posexplode(F.regexp_extract_all("value", F.lit(opening), F.lit(0))).alias("n", "xml"))
    xml = F.when(F.regexp_like("xml", F.lit(r"^<[^>]*/>$")), F.col("xml")).otherwise(F.concat("xml", F.lit(end)))
    parsed = F.from_xml(_capitals(xml), f"struct<{ROW}>", {"mode": "PERMISSIVE"})
    return _records(rows.select(F.struct("file", "part", "line", "n").alias("pos"), parsed.alias("r")), entity_type)


#: Collections that the accounting server is asked for: name, the tag of its rows, and what they are.
COLLECTIONS = (("Ledger", "LEDGER", "ledger"), ("StockItem", "STOCKITEM", "stock_item"))


def fetch_collections(spark: SparkSession, ask: Callable[[str], str], collections: tuple = COLLECTIONS) -> DataFrame:
    """Master records from the server's answers: ask(collection name) gives the XML body. Ledgers whose name tells a party are parties too."""
    parts = None
    for name, tag, kind in collections:
        rows = read_collection(spark.createDataFrame([(ask(name),)], "body string"), kind, tag)
        parts = rows if parts is None else parts.unionByName(rows)
    parties = parts.where((F.col("entity_type") == "ledger") & is_party(F.col("name"))).withColumn("entity_type", F.lit("party"))
    return parts.unionByName(parties)


def of_type(master: DataFrame, entity_type: str) -> DataFrame:
    """Records of one type (party, ledger or stock_item) in their order."""
    return master.where(F.col("entity_type") == entity_type).orderBy("pos")


def snapshots(spark: SparkSession, path: str) -> list[tuple[float, str]]:
    """(time, folder) of the whole snapshots below a path, the newest last."""
    system, pattern = shared.files(spark, f"{path}/snapshot-*/_SUCCESS")
    folders = [x.getPath().getParent() for x in system.globStatus(pattern) or ()]
    return sorted((float(x.getName().split("-")[1]), x.toString()) for x in folders)


def cached(spark: SparkSession, path: str, fetch, ttl: float = CACHE_SECONDS, force: bool = False, now: float | None = None, keep: float = KEEP_SECONDS) -> DataFrame:
    """The newest snapshot below path while it is at most ttl seconds old, else what fetch() gives, stored there.

    Each snapshot is a folder of its own, which counts once it is whole: who reads an
    older one is not disturbed, and a writer that dies leaves nothing that is read. What newer
    ones replaced is removed when it is keep seconds old.
    """
    now = time.time() if now is None else now
    found = snapshots(spark, path)
    if found and not force and now - found[-1][0] <= ttl:
        return spark.read.parquet(found[-1][1]).withColumn("source", F.lit("cache"))
    place = f"{path}/snapshot-{now:018.3f}-{uuid.uuid4().hex}"
    fetch().withColumn("fetched_at_epoch", F.lit(float(now))).write.parquet(place)
    for at, old in found:
        if now - at > keep:
            shared.delete(spark, old)
    return spark.read.parquet(place).withColumn("source", F.lit("live"))
