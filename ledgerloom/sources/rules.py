"""Mapping rules from JSON files and from a database snapshot."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as v
from ..functions.text import clean, strip
from . import shared

SCHEMA = "scope string, tenant_id string, entity_type string, key string, target string, provenance string, learned_at string"
KINDS = ("party", "ledger", "stock_item")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON file {global, tenants: {id: {kind: {key: value or {value, provenance, learned_at}}}}}.

    Keys stay as they are written; a rule without a value has a null target. A
    missing file gives no rules.
    """
    try:
        data = spark.read.text(path, wholetext=True).select(v.parse_json(F.col("value")).alias("d"))
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], SCHEMA)
    kinds = "map<string,variant>"
    own = data.select(F.lit("global").alias("scope"), F.lit(None).cast("string").alias("tenant_id"), v.member(F.col("d"), "global").alias("g"))
    tenants = data.select(F.explode(v.member(F.col("d"), "tenants").try_cast(kinds)).alias("tenant_id", "g")).select(F.lit("tenant").alias("scope"), "tenant_id", "g")
    rows = own.unionByName(tenants).select("scope", "tenant_id", F.explode(F.col("g").try_cast(kinds)).alias("entity_type", "m")).where(F.col("entity_type").isin(*KINDS))
    rows = rows.select("scope", "tenant_id", "entity_type", F.explode(F.col("m").try_cast(kinds)).alias("key", "r"))
    value = F.when(v.is_object(F.col("r")), v.text(v.member(F.col("r"), "value"))).otherwise(v.text(F.col("r")))
    return rows.select(
        "scope", "tenant_id", "entity_type", "key", clean(value).alias("target"), F.to_json(v.member(F.col("r"), "provenance")).alias("provenance"),
        v.text(v.member(F.col("r"), "learned_at")).alias("learned_at"),
    )


def learning_enabled(spark: SparkSession, path: str) -> DataFrame:
    """(tenant_id or null for all, enabled) of the file's settings; a tenant's own setting goes before the global one."""
    data = spark.read.text(path, wholetext=True).select(v.parse_json(F.col("value")).alias("d"))
    flag = lambda x: F.try_variant_get(x, "$.settings.learn_on_approval", "boolean")
    everyone = data.select(
        F.lit(None).cast("string").alias("tenant_id"),
        F.coalesce(flag(v.member(F.col("d"), "global")), flag(F.col("d")), F.lit(False)).alias("enabled"),
    )
    tenants = data.select(
        F.explode(v.member(F.col("d"), "tenants").try_cast("map<string,variant>")).alias("tenant_id", "g")
    ).select("tenant_id", flag(F.col("g")).alias("enabled")).where("enabled IS NOT NULL")
    return everyone.unionByName(tenants)


def from_snapshot(rows: DataFrame, target: str = "ledger_name") -> DataFrame:
    """Rules of a database snapshot (tenant_id, entity_type, normalized_value, target, ...) in scope db; older ones lack provenance."""
    more = [F.col(c) if c in rows.columns else F.lit(None) for c in ("provenance_json", "learned_at")]
    return rows.select(
        F.lit("db").alias("scope"), "tenant_id", "entity_type", F.col("normalized_value").alias("key"), F.col(target).alias("target"),
        more[0].cast("string").alias("provenance"), more[1].cast("string").alias("learned_at"),
    )


#: SQL states and messages of databases that lack a table: the standard's, Derby's, PostgreSQL's and SQL Server's; Oracle's and SQLite's words.
NO_TABLE_STATES, NO_TABLE_WORDS = ("42S02", "42X05", "42P01", "S0002"), ("ORA-00942", "no such table")


def _lacks_table(failed: Exception) -> bool:
    """Whether a database was reached and said that it has no such table."""
    cause = getattr(failed, "java_exception", None) or getattr(getattr(failed, "_origin", None), "java_exception", None) or getattr(failed, "_origin", None)
    while cause is not None and hasattr(cause, "getCause"):
        state = cause.getSQLState() if "SQL" in cause.getClass().getSimpleName() else None
        if state in NO_TABLE_STATES or any(w in str(cause.getMessage()) for w in NO_TABLE_WORDS):
            return True
        cause = cause.getCause()
    return False


def read_database(spark: SparkSession, url: str, table: str = "mapping_rules", target: str = "ledger_name", **options) -> DataFrame:
    """Rules of a database table over JDBC. A table that is not there yet gives no rules; any other failure is one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    try:
        rows = reader.load()
    except Exception as failed:
        if not _lacks_table(failed):
            raise
        return spark.createDataFrame([], SCHEMA)
    return from_snapshot(rows.select(*(F.col(c).alias(c.lower()) for c in rows.columns)), target)


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def from_approvals(learned: DataFrame, scope: str = "tenant", now: str | None = None) -> DataFrame:
    """Rules of the rows of learned (tenant_id, entity_type, key, target, status, approved_by) that are new."""
    at = F.lit(now) if now is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    provenance = F.to_json(F.struct(F.lit("approval").alias("source"), "approved_by", "tenant_id"))
    return learned.where("status = 'learned'").select(
        F.lit(scope).alias("scope"), "tenant_id", "entity_type", "key", strip(F.col("target")).alias("target"), provenance.alias("provenance"),
        at.alias("learned_at"),
    )


def learned_before(spark: SparkSession, path: str, number: str) -> DataFrame:
    """Rules that batches other than this one learnt, from the folders batch=... below path; none where there is no path.

    Each batch adds its own folder and changes no other's, so readers need no lock.
    If two batches learnt a key beside each other, what was learnt first holds.
    """
    if not shared.exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(f"{SCHEMA}, batch string").parquet(path).where(F.col("batch") != number)
    rest = [c for c in COLUMNS if c not in ("scope", "tenant_id", "entity_type", "key")]
    first = F.min(F.struct("learned_at", "batch", *(c for c in rest if c != "learned_at"))).alias("r")
    return rows.groupBy("scope", "tenant_id", "entity_type", "key").agg(first).select("scope", "tenant_id", "entity_type", "key", *(f"r.{c}" for c in rest))


def merged(rules: DataFrame, learned: DataFrame, scope: str = "tenant", now: str | None = None) -> DataFrame:
    """rules with those of learned (see from_approvals) that are new put in; a key's later rule wins."""
    new = from_approvals(learned, scope, now)
    both = rules.select(*COLUMNS, F.lit(0).alias("turn")).unionByName(new.withColumn("turn", F.lit(1)))
    best = F.max_by(F.struct("target", "provenance", "learned_at"), F.struct("turn", F.coalesce("learned_at", F.lit("")), F.coalesce("target", F.lit(""))))
    return both.groupBy("scope", "tenant_id", "entity_type", "key").agg(best.alias("r")).select("scope", "tenant_id", "entity_type", "key", "r.*")


def write_rules(rules: DataFrame, path: str, settings: dict | None = None) -> None:
    """One JSON file as read_rules reads it, put in place whole: written beside it and renamed. Rules fill one row, as their file does.

    settings: tenant_id (None for all) to whether approvals are learnt.
    """
    spark = rules.sparkSession
    rule = F.when(F.col("provenance").isNull() & F.col("learned_at").isNull(), F.to_json(F.struct(F.col("target").alias("v")))).otherwise(
        F.concat(
            F.lit('{"v":'),
            F.to_json(F.struct(F.col("target").alias("value"), F.from_json("provenance", "map<string,string>").alias("provenance"), "learned_at")),
            F.lit("}"),
        )
    )
    rows = rules.where("scope <> 'db'").select(F.when(F.col("scope") == "tenant", F.col("tenant_id")).alias("tenant_id"), "entity_type", "key", rule.alias("rule"))
    kinds: dict = {}
    for r in rows.toLocalIterator():
        kinds.setdefault(r.tenant_id, {}).setdefault(r.entity_type, {})[r.key] = json.loads(r.rule).get("v")
    for tenant, on in (settings or {}).items():
        kinds.setdefault(tenant, {})["settings"] = {"learn_on_approval": on}
    text = json.dumps({"global": kinds.pop(None, {}), "tenants": kinds}, indent=2, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.new")
    system, place = shared.files(spark, path)
    _, fresh = shared.files(spark, f"{path}.new")
    part = next(x.getPath() for x in system.listStatus(fresh) if x.getPath().getName().startswith("part-"))
    shared.replace(spark, system.makeQualified(part), system.makeQualified(place))
    system.delete(fresh, True)


KEYS = ("tenant_id", "entity_type", "normalized_value")
#: Types of the table's columns (lower case), where it is made or lacks them; keys are short enough for an index.
TYPES = dict.fromkeys(KEYS, "VARCHAR(200)") | {"provenance_json": "VARCHAR(4000)", "learned_at": "VARCHAR(40)"}


def _database_rows(rules: DataFrame, target: str) -> DataFrame:
    return rules.where("scope = 'db'").select(
        "tenant_id", "entity_type", F.col("key").alias("normalized_value"), F.col("target").alias(target),
        F.col("provenance").alias("provenance_json"), "learned_at",
    )


def upsert_database(rules: DataFrame, url: str, table: str = "mapping_rules", target: str = "ledger_name", **options) -> None:
    """Put the rules of scope db into a database table by key; rows of other keys, indexes and the table itself stay.

    Tasks write a table of their own beside it, which one MERGE then takes over in a
    transaction, so writers of different keys do not undo each other and readers see
    all or nothing. The latest rule of a key counts; rules without a whole key have no place
    there. A table that is not there is made with its primary key, and columns that an
    older one lacks are added. Doing it again changes nothing.
    """
    types = TYPES | {target: "VARCHAR(400)"}
    rest = [c for c in types if c not in KEYS]
    rows = _database_rows(rules, target).dropna(subset=list(KEYS))
    latest = F.max_by(F.struct(*rest), F.struct(F.coalesce("learned_at", F.lit("")), F.coalesce(target, F.lit("")))).alias("r")
    rows = rows.groupBy(*KEYS).agg(latest).select(*KEYS, *(f"r.{c}" for c in rest))
    beside = f"{table}_{uuid.uuid4().hex[:12]}"
    rows.write.format("jdbc").options(url=url, dbtable=beside, **options).save()
    jvm = rules.sparkSession._jvm
    login = jvm.java.util.Properties()
    for k, v_ in options.items():
        login.setProperty(k, str(v_))
    link = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        link.setAutoCommit(False)
        does = link.createStatement()
        try:
            found = does.executeQuery(f"SELECT * FROM {table} WHERE 1 = 0").getMetaData()
            named = [found.getColumnName(i + 1) for i in range(found.getColumnCount())]
        except Exception as failed:
            if not _lacks_table(failed):
                raise
            link.rollback()
            columns = ", ".join(f'"{c}" {t}{" NOT NULL" if c in KEYS else ""}' for c, t in types.items())
            does.executeUpdate(f"CREATE TABLE {table} ({columns}, PRIMARY KEY ({', '.join(f'"{c}"' for c in KEYS)}))")
            named = list(types)
        # names in quotes, as Spark writes them, in the case that the table has
        at = {c.lower(): f'"{c}"' for c in named}
        for c in types:
            if c not in at:
                at[c] = f'"{c}"'
                does.executeUpdate(f"ALTER TABLE {table} ADD COLUMN {at[c]} {types[c]}")
        new = {c: f'CAST(s."{c}" AS {t})' for c, t in types.items()}
        same = " AND ".join(f"t.{at[c]} = {new[c]}" for c in KEYS)
        does.executeUpdate(
            f"MERGE INTO {table} t USING {beside} s ON {same} WHEN MATCHED THEN UPDATE SET {', '.join(f'{at[c]} = {new[c]}' for c in rest)} "
            f"WHEN NOT MATCHED THEN INSERT ({', '.join(at[c] for c in types)}) VALUES ({', '.join(new.values())})"
        )
        link.commit()
    except BaseException:
        link.rollback()
        raise
    finally:
        try:
            link.createStatement().executeUpdate(f"DROP TABLE {beside}")
            link.commit()
        finally:
            link.close()


def write_database(rules: DataFrame, url: str, table: str = "mapping_rules", target: str = "ledger_name", **options) -> None:
    """The rules of scope db as the whole of a database table: the rows of `merged`, with the columns of from_snapshot."""
    rows = _database_rows(rules, target)
    place = shared.folder(rules.sparkSession, "rules")
    rows.write.parquet(place)  # the table may be what the rows come from
    rules.sparkSession.read.schema(rows.schema).parquet(place).write.format("jdbc").options(url=url, dbtable=table, **options).mode("overwrite").save()
