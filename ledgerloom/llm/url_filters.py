"""Host reputation from labelled page outcomes by empirical Bayes, and rules above it.

Outcomes (1 good, 0 bad) are counted by host. Beta-binomial priors are fitted
from the counts by the method of moments: suffixes are shrunk towards all
pages, registered domains towards their suffix, hosts towards their registered
domain. A host is blocked if even the upper posterior bound of its share of good
pages is below a threshold; a host without outcomes takes its domain's
posterior, and so on upwards. An explicit rule that fits a page wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: A host's bound is this many posterior standard deviations above its mean.
Z = 1.645
#: Block below this share of good pages.
LEAST_GOOD = 0.5
#: Rules up to this many are tested one by one on every row; more are joined.
INLINE_RULES = 200
# Public suffixes of two labels, under which names are registered.
SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "asn.au", "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.eg",
    "com.hk", "com.mx", "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.br", "edu.cn", "go.jp", "gob.mx",
    "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.pl", "or.at", "or.jp", "or.kr", "org.au", "org.br", "org.cn", "org.mx", "org.nz", "org.pl",
    "org.tr", "org.uk", "org.za",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, public suffix), without user, port and a point at the end; an IP address is its own domain, of suffix ``ip``."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    ip = plain.rlike(r"^\[.*\]$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    two = F.substring_index(plain, ".", -2)
    wide = two.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(ip, plain).when(wide, F.substring_index(plain, ".", -3)).otherwise(two)
    return domain, F.when(ip, "ip").when(wide, two).otherwise(F.substring_index(plain, ".", -1))


def _fit(rule: Column, verdict: Column) -> Column:
    return F.struct(F.length(rule).alias("n"), rule.alias("rule"), verdict.alias("verdict"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(n, rule, verdict), or null. Rules are (host + path prefix, verdict)."""
    fits = []
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        inside = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(inside & path.startswith(slash + rest), _fit(F.lit(rule), F.lit(verdict))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def join_rules(rows: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (host, path, ...) with fit as of rule_of, for any number of rules (rule, verdict).

    A host's rules have prefixes of some lengths. Each different host and path asks
    for its own beginnings of those lengths under each of the host's endings, by
    equality, so neither rules nor pages are compared pair by pair.
    """
    split = rules.select("rule", "verdict", F.regexp_extract("rule", r"^([^/]*)", 1).alias("ending"), F.regexp_extract("rule", r"^[^/]*(.*)$", 1).alias("prefix"))
    split = scratch.save(split.groupBy("ending", "prefix").agg(F.max(_fit(F.col("rule"), F.col("verdict"))).alias("fit")), "rules")
    lengths = scratch.side(split.groupBy("ending").agg(F.collect_set(F.length("prefix")).alias("lengths")), "lengths")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(endings).alias("ending")).join(lengths, "ending")
    asked = asked.select(
        "host", "path", "ending",
        F.explode(
            F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
        ).alias("prefix"),
    )
    found = asked.join(split, ["ending", "prefix"]).groupBy("host", "path").agg(F.max("fit").alias("fit"))
    return rows.join(found, ["host", "path"], "left")


def _strength(children: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength of each parent from its children's counts n and good.

    Kleinman's moments: the share of variance beyond binomial, kept within 0.01
    to 0.5, so that the strength is 1 to 99 outcomes.
    """
    stats = children.groupBy(*by).agg(
        F.sum("n").alias("t"), F.sum("good").alias("g"), F.count("*").alias("j"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("good") * F.col("good") / F.col("n")).alias("s2"),
    )
    p = F.col("g") / F.col("t")
    pq = p * (1 - p)
    spread = F.col("s2") - F.col("g") * p
    extra = F.try_divide(spread - pq * (F.col("j") - 1), pq * (F.col("t") - F.col("n2") / F.col("t") - (F.col("j") - 1)))
    share = F.least(F.lit(0.5), F.greatest(F.lit(0.01), F.coalesce(extra, F.lit(0.5))))
    return stats.select(*by, F.col("t").alias("n"), F.col("g").alias("good"), ((1 - share) / share).alias("strength"))


def _posterior(df: DataFrame, prior: Column, name: str) -> DataFrame:
    a = F.col("good") + F.col("strength") * prior
    b = F.col("n") - F.col("good") + F.col("strength") * (1 - prior)
    return df.withColumn(f"{name}_a", a).withColumn(f"{name}_b", b).withColumn(f"{name}_mean", a / (a + b))


def _bound(a: Column, b: Column, z: float) -> Column:
    """z standard deviations above the mean of a beta distribution, one at most: a normal approximation of its quantile."""
    return F.least(F.lit(1.0), a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))


def reputation(outcomes: DataFrame, url_col: str = "url", good_col: str = "good", z: float = Z, scratch: Scratch | None = None) -> DataFrame:
    """(level, name, n, good, a, b, mean, upper) for all hosts, registered domains, suffixes, and the whole ('').

    Outcomes with a null label or without a host count for nothing; repeated
    rows count each. Without outcomes the whole has the uniform prior alone.
    """
    scratch = scratch or Scratch(outcomes.sparkSession, "reputation")
    rows = outcomes.select(host_of(F.col(url_col)).alias("host"), F.col(good_col).cast("int").alias("good")).where("host <> '' and good is not null")
    hosts = scratch.save(rows.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good")), "hosts")
    domain, suffix = levels(F.col("host"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good")
    domains = scratch.save(_strength(hosts, ["suffix", "domain"]), "domains")
    suffixes = scratch.save(_strength(domains.select("suffix", "n", "good"), ["suffix"]), "suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    # one row: the share of good pages overall, and how far suffixes vary
    top = _strength(suffixes.select(F.lit(1).alias("one"), "n", "good"), ["one"])
    top = whole.join(top.select("strength"), F.lit(True), "left").withColumn("strength", F.coalesce("strength", F.lit(1.0)))
    top = top.select(
        "n", "good", (F.col("good") + 1.0).alias("a"), (F.col("n") - F.col("good") + 1.0).alias("b"), "strength",
    ).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))
    top = scratch.save(top, "whole")
    # prior strength of a level's nodes is their parent's
    s = suffixes.withColumnRenamed("strength", "own").crossJoin(F.broadcast(top.select("strength", F.col("mean").alias("prior"))))  # one row
    s = scratch.save(_posterior(s, F.col("prior"), "s").select("suffix", "n", "good", F.col("own").alias("strength"), "s_a", "s_b", "s_mean"), "suffix-posterior")
    d = domains.withColumnRenamed("strength", "own").join(s.select("suffix", "strength", F.col("s_mean").alias("prior")), "suffix")
    d = scratch.save(_posterior(d, F.col("prior"), "d").select("domain", "n", "good", F.col("own").alias("strength"), "d_a", "d_b", "d_mean"), "domain-posterior")
    h = hosts.join(d.select("domain", "strength", F.col("d_mean").alias("prior")), "domain")
    h = _posterior(h, F.col("prior"), "h")

    def level(df: DataFrame, kind: str, name: Column, a: str, b: str) -> DataFrame:
        return df.select(
            F.lit(kind).alias("level"), name.alias("name"), "n", "good", F.col(a).alias("a"), F.col(b).alias("b"),
            (F.col(a) / (F.col(a) + F.col(b))).alias("mean"), _bound(F.col(a), F.col(b), z).alias("upper"),
        )

    found = level(h, "host", F.col("host"), "h_a", "h_b").unionByName(level(d, "domain", F.col("domain"), "d_a", "d_b"))
    return found.unionByName(level(s, "suffix", F.col("suffix"), "s_a", "s_b")).unionByName(level(top, "whole", F.lit(""), "a", "b"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url",
    least_good: float = LEAST_GOOD, z: float = Z, scratch: Scratch | None = None,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mean, upper for every page.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins. Else the page is blocked if the upper posterior bound of
    its host (or the nearest level with outcomes) is below least_good. rules: a list,
    or a table (rule, verdict) of any size.

    Null urls and urls without `://` have an empty host and path, no rule, and
    the verdict of all pages together. Repeated rows each get their row; an
    empty table gives an empty one; other columns are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession, "reputation")
    known = scratch.save(reputation(outcomes, z=z, scratch=scratch), "levels")
    if isinstance(rules, list) and len(rules) > INLINE_RULES:
        rules = pages.sparkSession.createDataFrame(rules, "rule string, verdict string")
    top = known.where("level = 'whole'").first()
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    domain, suffix = levels(F.col("host"))
    rows = rows.withColumn("domain", domain).withColumn("suffix", suffix)
    for kind in ("host", "domain", "suffix"):
        one = known.where(F.col("level") == kind).select(F.col("name").alias(kind), F.struct("mean", "upper").alias(f"{kind}_p"))
        rows = rows.join(scratch.side(one, f"known-{kind}"), kind, "left")
    p = F.coalesce("host_p", "domain_p", "suffix_p", F.struct(F.lit(top["mean"]).alias("mean"), F.lit(top["upper"]).alias("upper")))
    rows = rows.withColumn("p", p)
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)) if isinstance(rules, list) else join_rules(rows, rules, scratch)
    own = F.when(F.col("p.upper") < least_good, "block").otherwise("allow")
    return rows.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), F.col("p.mean").alias("mean"),
        F.col("p.upper").alias("upper"),
    )
