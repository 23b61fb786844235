"""Order-sensitive building blocks that stay parallel inside one hot key.

A window partitioned by the key alone puts all rows of that key into one task. So keys are counted first: those with
few rows take a plain window, and chained windows of one operator share one shuffle. The rows of a hot key are cut
into blocks by a coarse, monotone function of the position; a window runs inside each block, a pre-aggregated summary
per block carries values across the cut, and one equi-join on (key, block) brings the carry back. Only the summaries,
one row per block, ever meet in one task.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, dealt

BLOCK_ROWS = 4096
BLOCK_SECONDS = 3600
HOT_ROWS = 1_000_000
HOT_ROWS_SETTING = "spark.pdpspark.hotRows"
MAX_HOT_KEYS = 10_000


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None), by a count per key with map-side combine.

    At most MAX_HOT_KEYS keys come to the driver and are broadcast; with more of them all rows take the hot path. The ordinary rows are dealt
    out by their key for the windows that follow, so that a task's share does not grow with the input.
    """
    spark = df.sparkSession
    limit = int(spark.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.collect_list(F.when(F.col("_n") > limit, F.struct(*keys)))  # at most one in `limit` rows
    rows, found = counts.agg(F.sum("_n"), F.slice(hot, 1, MAX_HOT_KEYS + 1)).first()
    if not found:
        return dealt(df, keys, rows or 0), None
    if len(found) > MAX_HOT_KEYS:
        return None, df
    few = F.broadcast(spark.createDataFrame(found, df.select(*keys).schema))
    same = functools.reduce(lambda x, y: x & y, [df[k].eqNullSafe(few[k]) for k in keys])
    return dealt(df.join(few, same, "left_anti"), keys, rows), df.join(few, same, "left_semi")


def per_key(operator):
    """Let an operator (df, keys, order, ..., block) run the plain way on ordinary keys and in blocks on hot ones."""
    shape = inspect.signature(operator)

    @functools.wraps(operator)
    def run(*args, **kwargs):
        call = shape.bind(*args, **kwargs)
        call.apply_defaults()
        if call.arguments["block"] is not None:
            return operator(**call.arguments)
        first = next(iter(shape.parameters))
        parts = [
            operator(**{**call.arguments, first: rows, "block": block})
            for rows, block in zip(split_hot(call.arguments[first], call.arguments["keys"]), (False, True))
            if rows is not None
        ]
        if isinstance(parts[0], tuple):
            return tuple(functools.reduce(DataFrame.unionByName, same) for same in zip(*parts))
        return functools.reduce(DataFrame.unionByName, parts)

    return run


@dataclass(frozen=True)
class Prev:
    """Value of the row before; NULL on the first row."""

    out: str
    value: Column


@dataclass(frozen=True)
class Next:
    """Value of the row after; NULL on the last row."""

    out: str
    value: Column


@dataclass(frozen=True)
class Fill:
    """Last non-NULL value so far; `strict` leaves the row itself out."""

    out: str
    value: Column
    strict: bool = False


@dataclass(frozen=True)
class FillNext:
    """First non-NULL value from here on; `strict` leaves the row itself out."""

    out: str
    value: Column
    strict: bool = False


@dataclass(frozen=True)
class Total:
    """Running sum including the row itself."""

    out: str
    value: Column


@dataclass(frozen=True)
class Highest:
    """Running maximum; `strict` leaves the row itself out."""

    out: str
    value: Column
    strict: bool = False


Spec = Prev | Next | Fill | FillNext | Total | Highest


def block_of(df: DataFrame, column: str) -> Column:
    """Coarse position of a row: monotone in `column`, so blocks follow each other in order."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_seconds(F.col(column).cast("timestamp")) / BLOCK_SECONDS)
    if isinstance(kind, T.NumericType):
        return F.floor(F.col(column) / BLOCK_ROWS)
    raise TypeError(f"pass block= for an ordering column of type {kind.simpleString()}")


@per_key
def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    block: Column | bool | None = None,
) -> DataFrame:
    """Add one column per spec. `order` must be unique within a key.

    `block` None: by the size of each key. False: one plain window, for groups bounded by construction (the sections
    of one parsed page). True or a Column: in blocks, each result materialised so that chained scans stay linear.
    """
    bounded = block is False
    cut = F.lit(0) if bounded else block_of(df, order[0]) if block is True else block
    values = {f"_scan_v{i}": s.value for i, s in enumerate(specs)}
    base = df.withColumns({"_scan_block": cut, **values})
    part = list(keys) if bounded else [*keys, "_scan_block"]
    up = Window.partitionBy(*part).orderBy(*[F.col(c).asc() for c in order])
    down = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])

    def run(window, strict: bool):
        return window.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)

    local: dict[str, Column] = {}
    for i, s in enumerate(specs):
        v = F.col(f"_scan_v{i}")
        if isinstance(s, Prev):
            local[f"_scan_l{i}"] = F.lag(F.struct(v.alias("v"))).over(up)
        elif isinstance(s, Next):
            local[f"_scan_l{i}"] = F.lead(F.struct(v.alias("v"))).over(up)
        elif isinstance(s, Fill):
            local[f"_scan_l{i}"] = F.last(v, ignorenulls=True).over(run(up, s.strict))
        elif isinstance(s, FillNext):
            local[f"_scan_l{i}"] = F.last(v, ignorenulls=True).over(run(down, s.strict))
        elif isinstance(s, Highest):
            local[f"_scan_l{i}"] = F.max(v).over(run(up, s.strict))
        else:
            local[f"_scan_l{i}"] = F.sum(v).over(run(up, False))
    out = base.withColumns(local)
    if bounded:
        final = {
            s.out: F.col(f"_scan_l{i}")["v"] if isinstance(s, (Prev, Next)) else F.col(f"_scan_l{i}") for i, s in enumerate(specs)
        }
        return out.withColumns(final).drop("_scan_block", *values, *local)

    place = F.struct(*order)
    summary, carry = [], {}
    up_blocks = Window.partitionBy(*keys).orderBy(F.col("_scan_block").asc())
    down_blocks = Window.partitionBy(*keys).orderBy(F.col("_scan_block").desc())
    for i, s in enumerate(specs):
        v, name = F.col(f"_scan_v{i}"), f"_scan_s{i}"
        if isinstance(s, Prev):
            summary.append(F.max_by(F.struct(v.alias("v")), place).alias(name))
            carry[f"_scan_c{i}"] = F.lag(name).over(up_blocks)
        elif isinstance(s, Next):
            summary.append(F.min_by(F.struct(v.alias("v")), place).alias(name))
            carry[f"_scan_c{i}"] = F.lead(name).over(up_blocks)
        elif isinstance(s, Fill):
            summary.append(F.max_by(v, F.when(v.isNotNull(), place)).alias(name))
            carry[f"_scan_c{i}"] = F.last(name, ignorenulls=True).over(run(up_blocks, True))
        elif isinstance(s, FillNext):
            summary.append(F.min_by(v, F.when(v.isNotNull(), place)).alias(name))
            carry[f"_scan_c{i}"] = F.last(name, ignorenulls=True).over(run(down_blocks, True))
        elif isinstance(s, Highest):
            summary.append(F.max(v).alias(name))
            carry[f"_scan_c{i}"] = F.max(name).over(run(up_blocks, True))
        else:
            summary.append(F.sum(v).alias(name))
            carry[f"_scan_c{i}"] = F.sum(name).over(run(up_blocks, True))
    carried = base.groupBy(*keys, "_scan_block").agg(*summary).withColumns(carry).select(*keys, "_scan_block", *carry)
    joined = out.join(carried, [*keys, "_scan_block"], "left")
    final = {}
    for i, s in enumerate(specs):
        here, before = F.col(f"_scan_l{i}"), F.col(f"_scan_c{i}")
        if isinstance(s, (Prev, Next)):
            final[s.out] = F.coalesce(here, before)["v"]
        elif isinstance(s, (Fill, FillNext)):
            final[s.out] = F.coalesce(here, before)
        elif isinstance(s, Highest):
            final[s.out] = F.greatest(here, before)
        else:
            final[s.out] = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    keep = [c for c in df.columns if c not in final]
    return cut_lineage(joined.withColumns(final).select(*keep, *final))


def with_group(df: DataFrame, keys: Sequence[str], values: dict[str, Column], block: Column | bool) -> DataFrame:
    """Add aggregates of each group to its rows: a window where the key is ordinary (it reuses the shuffle of the scans
    around it), a pre-aggregated join where it is hot."""
    if block is False:
        w = Window.partitionBy(*keys)
        return df.withColumns({name: value.over(w) for name, value in values.items()})
    return df.join(df.groupBy(*keys).agg(*[v.alias(n) for n, v in values.items()]), list(keys), "left")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1, rank: str | None = None) -> DataFrame:
    """First n rows per key. Spark limits every map task to n rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "__rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First-wins dedupe (W1): one row per key, the earliest."""
    return first_rows(df, keys, order)


@per_key
def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    seen: Column,
    joins: Callable[[Column], Column],
    out: str = "island",
    block: Column | bool | None = None,
) -> DataFrame:
    """Number runs of consecutive rows. `joins(prev)` says whether a row continues the run of the row before,
    `prev` being that row's `seen` struct (NULL on the first row)."""
    with_prev = scan(df, keys, order, [Prev("__prev", seen)], block)
    starts = F.when(F.coalesce(joins(F.col("__prev")), F.lit(False)), 0).otherwise(1)
    marked = with_prev.withColumn("__start", starts).drop("__prev")
    return scan(marked, keys, order, [Total(out, F.col("__start"))], block).drop("__start")


@per_key
def renumber(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "order_n",
             block: Column | bool | None = None) -> DataFrame:
    """Positions 1..n within a key (W14 with the kind among the keys)."""
    return scan(df, keys, order, [Total(out, F.lit(1))], block)


def mark_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], when: Column, out: str) -> DataFrame:
    """Flag the first row per key that meets `when`."""
    place = F.struct(*order)
    firsts = df.where(when).groupBy(*keys).agg(F.min(place).alias("__first"))
    return (
        df.join(firsts, list(keys), "left")
        .withColumn(out, F.coalesce(when & (place == F.col("__first")), F.lit(False)))
        .drop("__first")
    )


def cut_after_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], marks: Column) -> DataFrame:
    """Drop rows past the last marked row of a key; a key without marks stays whole."""
    place = F.struct(*order)
    lasts = df.where(marks).groupBy(*keys).agg(F.max(place).alias("__last"))
    return df.join(lasts, list(keys), "left").where(F.col("__last").isNull() | (place <= F.col("__last"))).drop("__last")
