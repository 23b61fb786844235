"""URL filter lists: host-suffix and path-prefix expressions, matched by short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdpspark.llm.common import ascii_lower

#: Hex digits of the digest that serve as join key; the rest confirms a hit.
KEY_DIGITS = 8


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _lengths(rules: DataFrame) -> tuple[list[int], list[int]]:
    """The label counts of rule hosts and the lengths of rule paths that occur: as many numbers as there are different lengths."""
    row = rules.agg(
        F.collect_set(F.size(F.split("host", "\\."))).alias("labels"), F.collect_set(F.length("path")).alias("paths"),
    ).first()
    return sorted(row.labels), sorted(row.paths)


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    pages needs a column url, rules the columns host, path and verdict (allow or block). A rule fits its host and all subdomains where
    the path starts with its own; the longest rule wins (then the longer host; of equal rules, block). Without a rule: default.

    Each different (host, path) is judged once, so a frequent address costs one row. It is expanded only to the suffixes and prefixes
    of lengths that rules have. Rules with a null host or path fit nothing. A null url, or one without ://, has an empty host and path,
    takes the default and has a null rule. Repeated rows stay; columns named host, path, rule or verdict are replaced.
    """
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(*columns).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null")
    labels, lengths = _lengths(rules)
    if not labels:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = rules.withColumn("rule", F.concat("host", "path")).withColumn("digest", F.sha2("rule", 256)).select(
        F.substring("digest", 1, KEY_DIGITS).alias("key"), "digest", "rule", "verdict", F.length("rule").alias("size"), F.length("host").alias("host_size"),
    )
    names = F.split("host", "\\.")
    suffixes = F.array(*[F.when(F.size(names) >= n, F.array_join(F.slice(names, -n, n), ".")) for n in labels])
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    expressions = F.flatten(F.transform(F.array_compact(suffixes), lambda h: F.transform(F.array_compact(prefixes), lambda p: F.concat(h, p))))
    asked = (
        parts.select("host", "path").where("host <> ''").distinct()
        .select("host", "path", F.explode(F.transform(expressions, lambda e: F.sha2(e, 256))).alias("digest"))
        .withColumn("key", F.substring("digest", 1, KEY_DIGITS))
    )
    hits = asked.join(listed.withColumnRenamed("digest", "full"), "key").where("digest = full")
    best = F.struct("size", "host_size", F.col("verdict") == "block", "rule", "verdict")
    found = hits.groupBy("host", "path").agg(F.max(best).alias("__best"))
    return (
        parts.join(found, ["host", "path"], "left")
        .select(*columns, "host", "path", F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))
    )
