"""The procurement tables that operators read, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.plans.staging import materialize


#: The day from which the official price index is used; before it, the chained one.
OFFICIAL_FROM = date(2016, 12, 1)


@dataclass
class Tables:
    """One DataFrame an entity; keys are unique except where an operator says otherwise."""

    process: DataFrame
    unit: DataFrame
    provider: DataFrame
    bid: DataFrame
    bid_line: DataFrame
    contract: DataFrame
    authorized_by: DataFrame
    contact: DataFrame
    price_index: DataFrame
    fx_rate: DataFrame
    #: Entities that a source may lack.
    contract_line: DataFrame | None = None
    provision_request: DataFrame | None = None
    provision_line: DataFrame | None = None
    #: Opinions on the bids of a process, keyed by (process_number, source, sequence), and their edges.
    opinion: DataFrame | None = None
    pre_award: DataFrame | None = None
    rejection: DataFrame | None = None
    opinion_signer: DataFrame | None = None
    official_from: date = OFFICIAL_FROM
    #: Whether it is known that no document comes twice among the valued contracts, so that rows count documents.
    single_documents: bool = False
    #: Frames derived from the others that several checks of a run read, by name; see ``runs.with_shared``.
    shared: dict[str, DataFrame] = field(default_factory=dict)


@dataclass
class Config:
    """Thresholds override the defaults of a check by name; a bound of the window may be open."""

    thresholds: dict[str, float] = field(default_factory=dict)
    weights: dict[str, int] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    date_from: date | None = None
    date_to: date | None = None
    #: Findings of a check at most; None keeps them all.
    limit: int | None = None
    #: Whether findings come sorted.  What only counts or joins them can do without the sort.
    ordered: bool = True

    def get(self, name: str, default: float) -> float:
        return self.thresholds.get(name, default)


def process_window(df: DataFrame, cfg: Config, column: str = "opening_date") -> DataFrame:
    """Rows within the run's dates; an open window keeps undated rows, a bound drops them."""
    day = F.to_date(column)
    if cfg.date_from is not None:
        df = df.filter(day >= F.lit(cfg.date_from))
    if cfg.date_to is not None:
        df = df.filter(day <= F.lit(cfg.date_to))
    return df


#: Up to so many rows, each task keeps its first ones and one task merges them.
TOP_IN_ONE = 10_000


def ordinals(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its rows numbered from 1 in an order: sorted by range, numbered in each partition, and shifted
    by the running total of the partitions before.  No task sees more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranged").withColumn("__p", F.shiftright("__m", 33))
    before = F.sum("k").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    shift = ranged.groupBy("__p").agg(F.count("*").alias("k")).select("__p", F.coalesce(before, F.lit(0)).alias("__o"))
    place = F.col("__o") + F.col("__m").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(shift), "__p").withColumn(name, place).drop("__m", "__p", "__o")


def top_n(df: DataFrame, order: list[Column], limit: int | None, ordered: bool = True) -> DataFrame:
    """The first rows in an order that ends with the row's key, so that ties cannot move; without a limit all
    rows.  A large limit cuts a range-partitioned sort at the running totals of its partitions."""
    if limit is None:
        return df.orderBy(*order) if ordered else df
    if limit <= TOP_IN_ONE:
        return df.orderBy(*order).limit(limit)
    first = ordinals(df, order, "__n").filter(F.col("__n") <= limit)
    return (first.orderBy("__n") if ordered else first).drop("__n")


def money(x: Column) -> Column:
    """Sums of money run in decimals, so that they do not depend on the order of rows."""
    return x.cast("decimal(38,8)")


def cents(total: Column) -> Column:
    return F.round(total, 2).cast("double")


def name_or_dash(x: Column) -> Column:
    return F.coalesce(x, F.lit("—"))
