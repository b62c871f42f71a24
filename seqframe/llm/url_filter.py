"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hash prefixes. [native]

Every step is a DataFrame operation. Each distinct (host, path) is expanded into the expressions host suffix + path
prefix, as deep as the deepest rule needs and no deeper (which loses nothing: no rule has more labels or slashes). A
path prefix ends at a slash or is empty; a rule is filed under the part of its path up to the last slash. Expressions
and rules meet in an equi-join on the first 4 bytes of their SHA-256; the full digests then confirm, and the rule's whole
path must start the url's. Of the rules that fit, the longest (host and path together) wins; of equal ones, block.

Rules are broadcast only if there are at most BROADCAST_RULES; else they are joined by a shuffle, with salted copies of
the rules so that a frequent expression is spread.

Defined cases: a null url or one without "://" has an empty host and path, and no rule. An empty path starts with no
rule path but the empty one. A url that no rule fits has a null rule and the verdict `default` ("allow"). Repeated rows
are judged alike and all returned; a null id is returned as it is; an empty table gives an empty result; other columns
of the input are left out unless named in `keep`. A null rule host, path or action makes the rule void.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host, path, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BROADCAST_RULES = 20_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.substring(url, cut + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, action string")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _slashes(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", keep: tuple[str, ...] = (), broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """id_col, host, path, rule, verdict, and the columns in `keep`, a row for each row of pages."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "action").dropna().distinct()
    rules = rules.withColumn("stem", F.regexp_extract("rule_path", r"^(?s)(.*/)?", 1))
    size = rules.agg(F.count("*"), F.coalesce(F.max(_labels(F.col("rule_host"))), F.lit(0)), F.coalesce(F.max(_slashes(F.col("stem"))), F.lit(0))).first()
    n_rules, deepest, longest = (int(x) for x in size)
    digest = lambda host, stem: F.sha2(F.concat(host, F.lit("\0"), stem), 256)
    rules = rules.withColumn("digest", digest(F.col("rule_host"), F.col("stem"))).withColumn("prefix", F.substring("digest", 1, 8))

    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), *keep, host.alias("host"), path.alias("path"))
    seen = parsed.select("host", "path").distinct().filter(F.col("host") != "")
    # Host suffixes: the last 1 to `deepest` labels. Path prefixes: nothing, and up to each of the first `longest` slashes.
    seen = seen.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.least(_labels(F.col("host")), F.lit(deepest)), F.lit(1))), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))))
    seen = seen.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(longest))), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("path"), F.lit("/"), n), F.lit("/"))))))
    seen = seen.withColumn("url_digest", digest(F.col("suffix"), F.col("stem"))).select("host", "path", "url_digest", F.substring("url_digest", 1, 8).alias("prefix"))
    rules = rules.drop("stem")
    if n_rules <= broadcast_rules:
        met = seen.join(F.broadcast(rules), "prefix")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = seen.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"])
    met = met.filter((F.col("digest") == F.col("url_digest")) & F.startswith(F.col("path"), F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (F.col("action") == "block").alias("b"), rule.alias("rule"), F.col("action").alias("action")))
    best = met.groupBy("host", "path").agg(best.alias("best")).select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.rule").alias("__rule"), F.col("best.action").alias("__action"))
    # Urls without a host need no partner. Both sides of the join come straight from a shuffle, the form in which adaptive
    # execution splits a very frequent url over tasks.
    out = parsed.filter(F.col("host") != "").join(best.repartition("__h", "__p"), (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left")
    none = F.lit(None).cast("string")
    out = out.drop("__h", "__p").union(parsed.filter(F.col("host") == "").select("*", none, none))
    return out.select(id_col, *keep, "host", "path", F.col("__rule").alias("rule"), F.coalesce("__action", F.lit(default)).alias("verdict"))
