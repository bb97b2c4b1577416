"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

Each URL expands into all pairs of one of its host's suffixes (cut at dots) and one of its path's prefixes.  Each
pair, written ``host#path`` (neither part of a URL has a ``#``), is hashed; URLs meet rules by an equi-join on the first bytes of the hash, a pair
counts only if the full digest agrees, and the longest rule decides.

Only DataFrame functions are used; the plan is one join of the URLs' expressions with the rules, which Spark
broadcasts only while their measured size is under its own threshold.

Defined cases.  Null URLs, and URLs without ``://``, have an empty host and path: no rule fits, and the default
verdict holds.  Rows that occur more than once get one result each.  Rules whose host or path is null fit nothing.
Of two rules of the same expression that disagree, block wins.  URLs of any length are read whole; an empty table, of URLs
or of rules, is fine.  Other columns of the URLs are kept, also where their
names clash with those of the rules; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8  # digits of a digest that take part in the join: 4 bytes
#: The rules of op10: verdict, host, path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


_HOST = r"^([^/?#]*)"
_PATH = r"^[^/?#]*([^?#]*)"


def split_url(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path of each URL; both empty for null or where there is no ``://``."""
    url = F.col(url_col)
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, _HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(F.regexp_extract(rest, _PATH, 1), F.lit(""))})


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (null where none fits) and verdict.

    The longest rule wins, by the length of its host and path together, then of its host.  Only the lengths of
    the rules' paths reach the driver: one number for each distinct length.
    """
    rules = rules.where("host is not null and path is not null and host <> ''").select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # 'block' > 'allow'
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().toLocalIterator())
    digest = F.sha2(F.concat_ws("#", "r_host", "r_path"), 256)
    rules = rules.withColumns({"r_digest": digest, "r_prefix": F.substring(digest, 1, PREFIX_HEX)})

    urls = split_url(pages.drop("host", "path", "rule", "verdict"), url_col)
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    labels = F.split("host", r"\.", -1)
    expressions = (
        urls.select("host", "path").where("host <> ''").distinct()
        .withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        .withColumn("cut", F.explode(cuts))
        .withColumn("digest", F.sha2(F.concat_ws("#", "suffix", F.col("path").substr(F.lit(1), F.col("cut"))), 256))
    )
    hits = expressions.join(rules, F.substring("digest", 1, PREFIX_HEX) == F.col("r_prefix")).where("digest = r_digest")
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), rank).alias("__best"))
    return (
        urls.join(best, ["host", "path"], "left")
        .select(*[c for c in urls.columns], F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    )
