"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into host suffix x path prefix expressions. Only the label
counts and path lengths that occur in the rules are expanded, which is exact: no
other expression can equal a rule. Expressions meet rules on the first bytes of
their SHA-256 (an equi-join), the full digest confirms, and the longest rule
decides; without one the verdict is the method's, ``allow``.

Null URLs and URLs without ``://`` have an empty host and path, match no rule
and are allowed. Repeated rows give one result row each. An empty table gives an
empty result. Only the given columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import lower_ascii

#: Up to so many rules the rule table is broadcast (about 200 bytes a rule).
BROADCAST_RULES = 100_000
#: Salts of the join with a larger rule table: hot expressions spread over them.
SALTS = 32
PREFIX_HEX = 8

RULES = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL: id column, host, path, rule, verdict.

    ``rules`` are (host, path, verdict) rows, given as a list or a table. A rule
    fits its host and all subdomains if the URL's path starts with its path. Of
    equally long rules the alphabetically first wins.
    """
    spark = pages.sparkSession
    table = spark.createDataFrame(rules, RULES) if isinstance(rules, list) else rules.select("host", "path", "verdict")
    table = table.select(lower_ascii("host").alias("host"), "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    hashed = table.select(F.concat("host", "path").alias("rule"), "verdict", F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("rule_digest")).withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))

    # identical rows collapse here and come back as _copies
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = [F.when(F.size("_labels") >= k, F.array_join(F.slice("_labels", F.lit(-k), F.lit(k)), ".")) for k in sorted(shape["labels"])]
    prefixes = [F.when(F.char_length("path") >= k, F.substring(F.col("path"), F.lit(1), F.lit(k))) for k in sorted(shape["lengths"])]
    expressions = [F.concat_ws("\n", s, p) for s in suffixes for p in prefixes]
    fits = [s.isNotNull() & p.isNotNull() for s in suffixes for p in prefixes]
    expanded = urls.withColumn("_labels", labels)
    expanded = expanded.select(
        id_col,
        "host",
        "path",
        F.posexplode(F.array(F.lit(None).cast("string"), *(F.when(f & (F.col("host") != ""), e) for f, e in zip(fits, expressions, strict=True)))).alias("_k", "expression"),
    ).where("_k = 0 OR expression IS NOT NULL")
    expanded = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:
        met = expanded.join(F.broadcast(hashed), "prefix", "left")
    else:
        salted = hashed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("_salt", F.pmod(F.xxhash64(id_col, "host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "_salt"], "left")
    hit = F.when(F.col("digest") == F.col("rule_digest"), F.struct((-F.char_length("rule")).alias("order"), "rule", "verdict"))
    judged = met.groupBy(id_col, "host", "path").agg(F.count_if(F.col("_k") == 0).alias("_copies"), F.min(hit).alias("best"))
    return judged.select(
        id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy")
    ).drop("_copy")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows whose URL is allowed, with all their columns. Verdicts are made
    once per distinct URL and joined back."""
    urls = pages.select(F.col(url_col).alias("_url")).distinct().withColumn("_key", F.col("_url"))
    blocked = url_verdicts(urls, rules, "_key", "_url", default).where("verdict = 'block'").select("_key")
    return pages.join(blocked, pages[url_col].eqNullSafe(blocked["_key"]), "left_anti")
