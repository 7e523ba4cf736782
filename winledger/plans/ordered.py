"""Ordered per-key computations that stay parallel when one key is very large.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key in one task. Here every key is cut into
order-preserving slices of about ``spark.winledger.sliceRows`` rows: a row is a cut point if the hash of its
key and place says so, so a key has as many slices as its rows ask for and most keys have one. Each slice is
scanned on its own, and what earlier or later slices contribute (a neighbouring row, a sum, a running
minimum) comes from a small per-slice summary. The plan is the same at every size, and results equal those
of the plain window.

Cut points are a pure function of the data and stay in tables that are joined; nothing comes to the driver.
The input is written to the checkpoint folder once, as several parts of the plan read it.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winledger.session import ensure_checkpoint_dir

SLICE_ROWS = 200_000
"""Rows of a slice on average (``spark.winledger.sliceRows``). A task sorts and buffers whole slices, and the largest of
many is several times the average."""
_BLOCK = 64  # cut points looked through at a time

SLICE = "_slice"

Exprs = Mapping[str, Column] | None


def held(df: DataFrame) -> DataFrame:
    """The rows as files in the shared checkpoint folder, for parts of a plan that read them again."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, for parts of a plan that read some columns again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keys that have cut points, with ``_cuts``: the points in order, in blocks."""
    every = int(df.sparkSession.conf.get("spark.winledger.sliceRows", str(SLICE_ROWS)))
    places = list(dict.fromkeys([*keys, *order]))
    marks = df.select(*places).filter(F.pmod(F.xxhash64(*places), F.lit(every)) == 0)
    points = marks.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.struct(*[F.col(c) for c in order]))).alias("_points"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_points") - 1) / _BLOCK).cast("int")),
                         lambda i: F.slice("_points", i * _BLOCK + 1, _BLOCK))
    return points.select(*keys, blocks.alias("_cuts"))


class Ordered:
    """Rows of each key in a total order (ascending, without NULLs), with columns added in order.

    ``add`` computes, per key: the previous or next row's value (``lag``, ``lead``), inclusive
    running sums, minima and maxima, the last non-NULL value so far (``carry``), and the list of the
    last k values including the row's own (``recent``, name -> (value, k), k small). Later ``add``
    calls may use earlier results and share their partitioning."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        rows = held(df)
        point = F.struct(*[F.col(c) for c in order])
        below = lambda cuts: F.size(F.filter(cuts, lambda c: c <= point))
        block = below(F.transform("_cuts", lambda b: b[0]))
        place = F.when(block == 0, 0).otherwise((block - 1) * _BLOCK + below(F.get("_cuts", block - 1)))
        self.df = (
            rows.join(_cuts(rows, keys, order), self.keys, "left")
            .withColumn(SLICE, F.when(F.col("_cuts").isNotNull(), place))
            .drop("_cuts")
        )
        self.steps = 0

    def map(self, change) -> Ordered:
        """Apply a row-wise change that keeps keys and order columns."""
        self.df = change(self.df)
        return self

    def result(self) -> DataFrame:
        return self.df.drop(SLICE)

    def _window(self):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def _again(self) -> None:
        """Before a further step: what was added is written once, as the step reads it twice."""
        if self.steps:
            self.df = held(self.df)
        self.steps += 1

    @staticmethod
    def _local(kind: str, value: Column, window) -> Column:
        upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return {
            "lag": lambda: F.lag(value).over(window),
            "lead": lambda: F.lead(value).over(window),
            "sum": lambda: F.sum(value).over(upto),
            "min": lambda: F.min(value).over(upto),
            "max": lambda: F.max(value).over(upto),
            "carry": lambda: F.last(value, ignorenulls=True).over(upto),
        }[kind]()

    def add(
        self, *, lag: Exprs = None, lead: Exprs = None, running_sum: Exprs = None,
        carry: Exprs = None, running_min: Exprs = None, running_max: Exprs = None,
        recent: Mapping[str, tuple[Column, int]] | None = None,
    ) -> Ordered:
        for name, (value, k) in (recent or {}).items():
            self._add_recent(name, value, k)
        wanted = [
            (kind, name, value)
            for kind, group in (
                ("lag", lag), ("lead", lead), ("sum", running_sum), ("carry", carry),
                ("min", running_min), ("max", running_max),
            )
            for name, value in (group or {}).items()
        ]
        if not wanted:
            return self
        self._again()
        window = self._window()
        columns = self.df.columns
        base = self.df.select("*", *[v.alias(f"_in_{n}") for _, n, v in wanted])
        local = base.select(
            "*",
            *[self._local(k, F.col(f"_in_{n}"), window).alias(f"_at_{n}") for k, n, _ in wanted],
            F.lag(F.lit(1)).over(window).isNull().alias("_slice_opens"),
            F.lead(F.lit(1)).over(window).isNull().alias("_slice_closes"),
        )
        point = F.struct(*[F.col(c) for c in self.order])

        def whole(kind: str, v: Column) -> Column:
            return {
                "lag": F.max_by(F.struct(v.alias("v")), point),
                "lead": F.min_by(F.struct(v.alias("v")), point),
                "sum": F.sum(v) if kind == "sum" else None,
                "carry": F.max_by(v, F.when(v.isNotNull(), point)),
                "min": F.min(v),
                "max": F.max(v),
            }[kind]

        summary = (
            base.filter(F.col(SLICE).isNotNull()).groupBy(*self.keys, SLICE)
            .agg(*[whole(k, F.col(f"_in_{n}")).alias(f"_all_{n}") for k, n, _ in wanted])
        )
        slices = Window.partitionBy(*self.keys).orderBy(SLICE)
        earlier = slices.rowsBetween(Window.unboundedPreceding, -1)

        def outside(kind: str, v: Column) -> Column:
            return {
                "lag": lambda: F.lag(v).over(slices),
                "lead": lambda: F.lead(v).over(slices),
                "sum": lambda: F.sum(v).over(earlier),
                "carry": lambda: F.last(v, ignorenulls=True).over(earlier),
                "min": lambda: F.min(v).over(earlier),
                "max": lambda: F.max(v).over(earlier),
            }[kind]()

        offsets = summary.select(
            *self.keys, SLICE,
            *[outside(k, F.col(f"_all_{n}")).alias(f"_pre_{n}") for k, n, _ in wanted],
        )

        def combined(kind: str, n: str) -> Column:
            here, pre = F.col(f"_at_{n}"), F.col(f"_pre_{n}")
            if kind in ("lag", "lead"):
                edge = F.col("_slice_opens" if kind == "lag" else "_slice_closes")
                return F.when(edge & pre.isNotNull(), pre["v"]).otherwise(here)
            if kind == "sum":
                return F.when(pre.isNull(), here).when(here.isNull(), pre).otherwise(here + pre)
            if kind == "carry":
                return F.coalesce(here, pre)
            return F.least(here, pre) if kind == "min" else F.greatest(here, pre)

        joined = local.join(offsets, [*self.keys, SLICE], "left")
        self.df = joined.select(
            *columns, *[combined(kind, n).alias(n) for kind, n, _ in wanted]
        )
        return self

    def _add_recent(self, name: str, value: Column, k: int) -> None:
        # Wrapped, so that NULL values keep their place.
        self._again()
        boxed = F.struct(value.alias("v"))
        frame = self._window().rowsBetween(-(k - 1), 0)
        unbox = lambda c: F.transform(c, lambda b: b["v"])
        columns = self.df.columns
        local = self.df.withColumn(name, F.collect_list(boxed).over(frame))
        point = F.struct(*[F.col(c) for c in self.order])
        backwards = Window.partitionBy(*self.keys, SLICE).orderBy(
            *[F.col(c).desc() for c in self.order]
        )
        tails = (
            self.df.filter(F.col(SLICE).isNotNull())
            .select(*self.keys, SLICE, point.alias("_p"), boxed.alias("_b"), *[
                F.col(c) for c in self.order if c not in self.keys])
            .withColumn("_r", F.row_number().over(backwards)).filter(F.col("_r") < k)
            .groupBy(*self.keys, SLICE)
            .agg(F.array_sort(F.collect_list(F.struct("_p", "_b"))).alias("_t"))
        )
        # Every slice has a row, so the k - 1 before it hold all that can count.
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(-(k - 1), -1)
        before = tails.select(
            *self.keys, SLICE,
            F.transform(F.flatten(F.collect_list("_t").over(earlier)), lambda e: e["_b"])
            .alias("_pre"),
        )
        every = F.concat(F.coalesce(F.col("_pre"), F.slice(F.col(name), 1, 0)), F.col(name))
        last = F.slice(every, F.greatest(F.size(every) - k + 1, F.lit(1)), F.lit(k))
        self.df = local.join(before, [*self.keys, SLICE], "left").select(
            *columns, unbox(last).alias(name)
        )


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], **added) -> DataFrame:
    """One ``Ordered.add`` step."""
    return Ordered(df, keys, order).add(**added).result()


def ranked(df: DataFrame, order: Mapping[str, Column], name: str = "rank") -> DataFrame:
    """Rows with their place among all, from 1, by ``order`` (ascending, without NULLs): slices of the whole
    table are numbered side by side, so no task sees all rows."""
    rows = df.withColumns({"_all": F.lit(0), **order})
    numbered = scan(rows, ["_all"], list(order), running_sum={name: F.lit(1)})
    return numbered.withColumn(name, F.col(name).cast("int")).drop("_all", *order)
