"""Benchmark decontamination: exact shingle containment by one join of all shingles; items carry a size-partitioned MinHash sketch as a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdpspark.llm.common import SHINGLE_WORDS, shingle_hashes, words, written

#: Share of an item's different shingles that a document must hold.
CONTAINED = 0.75


def item_shingles(items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """item_id, k, shingle, n (different shingles of the item) and sketch: whether the shingle is in the item's bottom-m MinHash sketch.

    Items are partitioned by size: class c holds the items of 2**(c-1) < n <= 2**c shingles, and m is floor((1 - contained) * 2**c) + 1
    (n at most). A document that holds the share `contained` of an item lacks fewer than m of its shingles, so it holds one of the
    sketch at least: the search misses nothing. Items of fewer than five words have one shingle of all k words.
    """
    tokens = items.where("item_id is not null").dropDuplicates(["item_id", "text"]).select("item_id", words(F.col("text")).alias("tokens")).where("size(tokens) > 0")
    hashed = F.coalesce(*[F.when(F.size("tokens") == k, F.struct(F.lit(k).alias("k"), shingle_hashes(F.col("tokens"), k).alias("hashes"))) for k in range(1, SHINGLE_WORDS)],
                        F.struct(F.lit(SHINGLE_WORDS).alias("k"), shingle_hashes(F.col("tokens")).alias("hashes")))
    sets = tokens.select("item_id", hashed.alias("h")).select("item_id", "h.k", F.array_sort(F.array_distinct("h.hashes")).alias("shingles")).withColumn("n", F.size("shingles"))
    m = F.least("n", (F.floor((1 - contained) * F.pow(2.0, F.ceil(F.log2("n"))) + 1e-9) + 1).cast("int"))
    return sets.select("item_id", "k", "n", F.posexplode("shingles").alias("rank", "shingle"), m.alias("m")).select("item_id", "k", "shingle", "n", (F.col("rank") < F.col("m")).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment: every document and item with n_found >= contained * n_item different shingles.

    The whole text of every document is searched. The table of item shingles is written first, so that the optimizer knows its size and
    broadcasts it only below the session's threshold; beyond it both sides meet by hash of the shingle. The join takes all
    shingles of the items, so it is exact by itself; the sketch only flags pairs and excludes none that passes. A passage in many documents gives one row per
    document; nothing is gathered per item. Null or blank texts, on either side, match nothing; rows with a null id are left out (a
    null id names no document). Repeated documents or items count once; rows of one id with several texts count as one document.
    """
    listed = written(item_shingles(items, contained), "benchmark-shingles")
    widths = [r.k for r in listed.select("k").distinct().collect()]  # 1 to 5
    tokens = docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("tokens"))
    found = None
    for k in sorted(widths):
        held = tokens.select("doc_id", F.explode(shingle_hashes(F.col("tokens"), k)).alias("shingle"))
        hits = held.join(listed.where(F.col("k") == k).drop("k"), "shingle")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = listed.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", "shingle", "n", "sketch")  # no item has a word: no row
    once = found.groupBy("doc_id", "item_id", "shingle").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    return (
        once.groupBy("doc_id", "item_id").agg(F.max("n").cast("long").alias("n_item"), F.count("*").alias("n_found"), F.max("sketch").alias("candidate"))
        .where(F.col("candidate") & (F.col("n_found") >= contained * F.col("n_item") - 1e-9))
        .select("doc_id", "item_id", "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment"))
    )
