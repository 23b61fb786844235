"""Versioned texts, object manifests, soft deletes, corpus re-derivation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from .channels import LISTING_FIELDS
from .ordered import Total, scan

# Field length limits of a listing text.
FIELD_LIMIT, TITLE_LIMIT, NOTE_LIMIT, BY_LIMIT = 20000, 120, 200, 40


def clean_fields(fields: Column, limit: int = FIELD_LIMIT) -> Column:
    """The five fields of a listing text, cut to their limit."""
    pairs = [x for k in LISTING_FIELDS for x in (F.lit(k), text.clip(F.try_element_at(fields, F.lit(k)), limit))]
    return F.create_map(*pairs)


def add_version(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str], block=None) -> DataFrame:
    """Store with a batch appended (V1): numbers go on from the highest ever given, deleted ones included."""
    top = store.groupBy(*keys).agg(F.max("v").alias("__top"))
    new = scan(batch, keys, order, [Total("__n", F.lit(1))], block).join(top, keys, "left")
    numbered = new.withColumn("v", (F.coalesce("__top", F.lit(0)) + F.col("__n")).cast(store.schema["v"].dataType)).withColumn(
        "deleted", F.lit(False))
    return store.unionByName(numbered.select(*store.columns))


def current_version(store: DataFrame, pins: DataFrame, keys: list[str], blank: Column | None = None) -> DataFrame:
    """The version a key shows (V2): the pinned one if it still exists, else the last; nothing when all fields are blank."""
    live = store.where("not deleted")
    pinned = live.join(pins.select(*keys, F.col("v").alias("__pin")), keys, "left")
    rest = [c for c in store.columns if c not in keys]
    best = pinned.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct((F.col("v") == F.coalesce("__pin", F.lit(-1))).alias("p"), F.col("v").alias("v"))).alias("r")
    )
    out = best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
    return out if blank is None else out.where(~blank)


def fields_blank(fields: str = "fields") -> Column:
    return F.forall(F.map_values(fields), lambda v: F.trim(F.coalesce(v, F.lit(""))) == "")


def delete_version(store: DataFrame, pins: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(store with tombstones, pins without the deleted versions) (V3)."""
    marks = gone.select(*keys, "v").distinct().withColumn("__x", F.lit(True))
    tombs = store.join(marks, [*keys, "v"], "left").withColumn("deleted", F.col("deleted") | F.coalesce("__x", F.lit(False))).drop("__x")
    return tombs.select(*store.columns), pins.join(marks.select(*keys, "v"), [*keys, "v"], "left_anti").select(*pins.columns)


def listing_index(store: DataFrame, corp: str, keys: list[str]) -> DataFrame:
    """Latest live version per corporation and key (V4); keys without one drop out."""
    live = store.where("not deleted")
    rest = [c for c in store.columns if c not in (corp, *keys, "deleted")]
    return live.groupBy(corp, *keys).agg(F.max_by(F.struct(*rest), "v").alias("r")).select(
        corp, *keys, *[F.col(f"r.{c}").alias(c) for c in rest])


# ---------------------------------------------------------------- manifests (K2, K8), trash (K7)


def sync_plan(local: DataFrame, remote: DataFrame, check_md5: bool = True) -> DataFrame:
    """(root, rel, action, size) per object (K2): missing or different ones move, excluded paths stay out.

    A 32-digit etag is compared with the md5 of the local object; any other etag only by size.
    """
    a = local.where(rules.is_syncable("rel")).select("root", "rel", F.col("size").alias("a_size"), F.col("md5").alias("a_md5"))
    b = remote.where(rules.is_syncable("rel") & ~F.array_contains(F.split("rel", "/"), "..")).select(
        "root", "rel", F.col("size").alias("b_size"), F.col("md5").alias("b_md5"))
    same = F.col("a_size") == F.col("b_size")
    if check_md5:
        same = same & (~F.col("b_md5").rlike("^[0-9a-f]{32}$") | (F.col("a_md5") == F.col("b_md5")))
    action = F.when(F.col("b_size").isNull(), "upload").when(F.col("a_size").isNull(), "download").when(same, "unchanged").otherwise("differs")
    return a.join(b, ["root", "rel"], "full_outer").select("root", "rel", action.alias("action"), F.coalesce("a_size", "b_size").alias("size"))


def sync_stats(plan: DataFrame) -> DataFrame:
    """Objects and bytes per action."""
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def bundle_manifest(entries: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checked entries with `problem`, entries whose object is missing) (K8)."""
    path = F.left(F.array_join(F.filter(
        F.transform(F.split(F.regexp_replace("path", r'[\x00-\x1f\\:*?"<>|]+', "_"), "/"), lambda p: F.trim(p)), lambda p: ~p.isin("", ".", "..")), "/"), F.lit(240))
    rows = entries.withColumn("clean_path", path)
    twice = rows.groupBy("clean_path").agg(F.count(F.lit(1)).alias("__n"))
    problem = (
        F.when(~F.col("hash").rlike("^[0-9a-f]{20}$"), "bad hash").when(~F.col("file").rlike(r"^[\w-]+\.(jpg|png)$"), "bad file")
        .when(F.col("clean_path") == "", "bad path").when(F.col("__n") > 1, "duplicate path")
    )
    checked = rows.join(twice, "clean_path").withColumn("problem", problem).drop("__n")
    missing = checked.where("problem is null").join(stored.select("hash", "file").distinct(), ["hash", "file"], "left_anti")
    return checked, missing


def soft_delete(table: DataFrame, slugs: DataFrame, stamp: str, key: str = "slug") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, trash rows with their stamp and trash key) (K7)."""
    gone = table.join(slugs.select(key).distinct(), key, "left_semi")
    trash = gone.withColumns({"stamp": F.lit(stamp), "trash_key": F.concat(F.lit(f"trash/{stamp}/"), F.col(key))})
    return table.join(slugs.select(key).distinct(), key, "left_anti"), trash


# ---------------------------------------------------------------- re-derivation (R1), product view


def rebuild(new_sections: DataFrame, old_sections: DataFrame, minimum: int = 3) -> tuple[DataFrame, DataFrame]:
    """(sections to publish, before/after report).

    A page is replaced when its new sections pass the gate of `minimum` renderable ones; otherwise its old sections stay.
    """
    good = new_sections.groupBy("page_id").agg(F.count_if("renderable").alias("n")).where(F.col("n") >= minimum).select("page_id")
    out = new_sections.join(good, "page_id", "left_semi").unionByName(
        old_sections.join(good, "page_id", "left_anti"), allowMissingColumns=True)
    count = lambda df, name: df.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))
    mode = good.withColumn("mode", F.lit("rebuild"))
    report = count(old_sections, "before").join(count(out, "after"), "page_id", "full_outer").join(mode, "page_id", "left")
    return out, report.fillna(0, ["before", "after"]).fillna("filter", ["mode"])


def product_view(products: DataFrame, qa: DataFrame, geo: DataFrame, listings: DataFrame, key: str = "slug") -> DataFrame:
    """One row per product with its reports and listing text."""
    return products.join(qa, key, "left").join(geo, key, "left").join(listings, key, "left")
