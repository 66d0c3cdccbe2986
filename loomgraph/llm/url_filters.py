"""Operator 8: URL filters by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import table

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both are empty where the url is null or has no `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn("host", F.coalesce(low, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", digest_hex: int = 8) -> DataFrame:
    """Judge every row of pages (page_id, url) against rules (verdict, rule_host, rule_path).

    Each url becomes host-suffix + path-prefix expressions: suffixes of the host that start at a label, prefixes of
    the path, both of the lengths that rules have, so a long url has no more of them than there are lengths.
    Expressions and rules meet on the first `digest_hex` hex digits of their SHA-256; whole digests are compared
    afterwards.  The longest rule (host and path) wins, then the smaller rule text, then the smaller verdict.
    Rows without a matching rule get `default`.  Repeated rows are judged one by one; a null url has empty host
    and path, hence the default; other columns of pages are not returned.  The rules join by Spark's own choice:
    broadcast only if their size is known to be under the session's threshold.
    """
    rules = rules.dropna(subset=["verdict", "rule_host", "rule_path"]).dropDuplicates()
    # distinct lengths only: at most the longest rule host or path of them
    hosts, paths = (
        F.array(*[F.lit(r[0]) for r in rules.select(F.length(c)).distinct().sort(F.length(c)).collect()]).cast("array<int>")
        for c in ("rule_host", "rule_path")
    )
    keyed = rules.withColumn("rule", F.concat("rule_host", "rule_path")).select(
        "rule", "verdict", F.sha2(F.concat_ws("\u0000", "rule_host", "rule_path"), 256).alias("digest")
    ).withColumn("short", F.substring("digest", 1, digest_hex))
    rows = with_host_and_path(pages.select("page_id", "url")).withColumn("rid", F.monotonically_increasing_id())
    host, size = F.col("host"), F.length("host")
    at_label = F.filter(hosts, lambda n: (n == size) | ((n < size) & (F.substring(host, size - n, F.lit(1)) == ".")))
    suffixes = F.transform(at_label, lambda n: F.substring(host, size - n + 1, n))
    prefixes = F.transform(
        F.filter(paths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    parts = rows.select(
        "rid", "page_id", "host", "path", F.explode_outer(suffixes).alias("suffix"), prefixes.alias("prefixes")
    ).select("rid", "page_id", "host", "path", "suffix", F.explode_outer("prefixes").alias("prefix"))
    digests = parts.withColumn("digest", F.sha2(F.concat(F.col("suffix"), F.lit("\u0000"), F.col("prefix")), 256)).drop("suffix", "prefix")
    digests = digests.withColumn("short", F.substring("digest", 1, digest_hex))
    met = digests.alias("u").join(keyed.alias("r"), F.col("u.short") == F.col("r.short"), "left")
    # short digests have met; only an equal whole digest makes a rule count
    order = F.when(
        F.col("u.digest") == F.col("r.digest"), F.struct((-F.length("r.rule")).alias("rank"), F.col("r.rule"), F.col("r.verdict"))
    )
    best = met.groupBy("rid", "page_id", "host", "path").agg(F.min(order).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of RULES on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), f AS (
  SELECT *, (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') AS net,
    (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') AS en,
    (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') AS de,
    (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') AS fr
  FROM p
)
SELECT page_id, host, path,
  CASE WHEN en THEN 'example.net/en/' WHEN de THEN 'example.com/de/' WHEN fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN en THEN 'allow' WHEN de THEN 'block' WHEN fr THEN 'allow' WHEN net THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
