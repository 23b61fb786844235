"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sites from which on a line is boilerplate.
MIN_SITES = 4
#: 2**LG_K registers: a relative standard error of 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12
#: Estimates within so many standard errors of the threshold, and at least one site from it, are counted exactly.
ERRORS = 6.0


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line hash and first place (doc_id, pos) of the lines that min_sites sites or more have.

    lines: line (64-bit hash), site, doc_id, pos. A null site counts as no site. A frequent line is one row per task before each
    shuffle: the counts, the sketches and the distinct (line, site) pairs are all combined on the map side.
    """
    wide = lines.groupBy("line").agg(
        F.min("site").alias("low"), F.max("site").alias("high"), F.min(F.struct("doc_id", "pos")).alias("first"),
    ).where("low <> high" if min_sites > 1 else "low is not null")
    sites = lines.join(wide.select("line"), "line", "left_semi").where("site is not null").groupBy("line", "site").agg(F.lit(1).alias("one"))
    sketched = sites.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"))
    margin = max(1.0, ERRORS * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = sketched.where(F.abs(F.col("estimate") - min_sites) <= margin)
    exact = sites.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    far = sketched.where(F.col("estimate") > min_sites + margin)
    return wide.join(far.select("line").unionByName(exact.select("line")), "line", "left_semi").select("line", "first")


def drop_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text; n_lines and n_removed tell how many lines there were and went.

    docs needs doc_id, text and source (the site). Lines are what stands between line feeds; two are equal when they are so without
    spaces at the ends; blank lines are never boilerplate. With keep_first the occurrence of the smallest (doc_id, position) stays,
    so what the sites share is not lost from the corpus. A null text stays null (0 lines), an empty one has one blank line. Rows with a
    null doc_id or source are cleaned like others (a null source adds no site). Equal rows are treated alike. Columns of other names
    stay, n_lines and n_removed are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.xxhash64("doc_id", "text")
    cut = F.split("text", "\n")
    lines = (
        docs.select("doc_id", F.col("source").alias("site"), row.alias("__row"), F.posexplode(cut).alias("pos", "words"))
        .withColumn("words", F.trim("words")).where("words <> ''")
        .select("doc_id", "site", "__row", "pos", F.xxhash64("words").alias("line"))
    )
    gone = lines.join(spread_lines(lines.drop("__row"), min_sites), "line")
    if keep_first:
        gone = gone.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    per_row = gone.groupBy("__row").agg(F.collect_set("pos").alias("__drop"))
    kept = F.filter(cut, lambda _, i: ~F.array_contains("__drop", i))
    return (
        docs.select(*columns, row.alias("__row")).join(per_row, "__row", "left")
        .withColumns({
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(cut)).cast("long"),
            "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
            "text": F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        })
        .withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
        .select(*columns, "n_lines", "n_removed")
    )
