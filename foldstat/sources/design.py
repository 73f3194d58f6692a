"""From a DataFrame and named roles to the projected numeric columns every pass reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..operators.fold import fold, fold_here

#: Cells of a table in memory up to which passes run on the driver.
NEAR = 2_000_000


def number(df: DataFrame, name: str) -> Column:
    """The column as a double: null where it is null or no number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(df[f"`{name}`"]).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return df[f"`{name}`"].cast("timestamp").cast("double")
    if not isinstance(kind, (T.NumericType, T.BooleanType, T.StringType, T.TimestampType)):
        raise ValidationError(f"column '{name}' could not be cast to a numeric type (f64): {kind.simpleString()}")
    return df[f"`{name}`"].try_cast("double")


def key(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise ValidationError(f"column '{name}' could not be interpreted as a group key: {kind.simpleString()}")
    return df[f"`{name}`"].cast("string")


def known_rows(df: DataFrame) -> int | None:
    """The most rows ``df`` can have, where its plan alone proves it: projections and filters of a loaded cache, a range or literals."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter"):
        plan = plan.children().head()
    if kind not in ("InMemoryRelation", "Range", "LocalRelation") or (kind == "InMemoryRelation" and not plan.cacheBuilder().isCachedColumnBuffersLoaded()):
        return None
    rows = plan.stats().rowCount()
    return int(str(rows.get())) if rows.isDefined() else None


@dataclass
class Design:
    """The rows of ``df`` as numbers: ``columns`` in order, then weight and time where given; a cluster key beside them.

    Time counts as a number for the validity checks alone; rows are ordered by the column itself, by its numbers if it holds strings.
    """

    df: DataFrame
    columns: list[str]
    weight: str | None = None
    time: str | None = None
    cluster: str | None = None
    ties: tuple[str, ...] = ()
    cached: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        for name in [*self.numeric, *([self.cluster] if self.cluster else []), *self.ties]:
            if name not in self.df.columns:
                raise ValidationError(f"column '{name}' does not exist in the data")

    @property
    def numeric(self) -> list[str]:
        return [*self.columns, *([self.weight] if self.weight else []), *([self.time] if self.time else [])]

    @cached_property
    def frame(self) -> DataFrame:
        """``_0``, ``_1``, ... doubles; ``_s0``, ... whether a string column is null before the cast; ``_g`` the cluster key; ``_t`` the time itself."""
        df = self.df
        out = [number(df, n).alias(f"_{i}") for i, n in enumerate(self.numeric)]
        out += [df[f"`{n}`"].isNull().alias(f"_s{i}") for i, n in enumerate(self.numeric) if isinstance(df.schema[n].dataType, T.StringType)]
        if self.cluster:
            out.append(key(df, self.cluster).alias("_g"))
        if self.time and not isinstance(df.schema[self.time].dataType, T.StringType):
            out.append(df[f"`{self.time}`"].alias("_t"))  # wide integers and fine timestamps have an order that doubles lose
        out += [df[f"`{n}`"].alias(f"_o{i}") for i, n in enumerate(self.ties)]
        return df.select(*out)

    @property
    def numbers(self) -> DataFrame:
        """What the passes after the first read: the doubles alone (and the cluster key)."""
        frame = self.cached if self.cached is not None else self.frame
        return frame.select(*[f"_{i}" for i in range(len(self.numeric))], *(["_g"] if self.cluster else []))

    @cached_property
    def near(self) -> pa.Table | None:
        """All rows of ``frame``, if a bound known without any job says that they are few: a job for each pass would cost more than they do."""
        rows = known_rows(self.frame)
        return self.frame.toArrow() if rows is not None and rows * len(self.frame.columns) <= NEAR else None

    def fold(self, start: Callable, step: Callable, merge: Callable, checked: bool = True):
        """A pass over ``numbers``; over the columns of the validity checks too, if the rows are not ``checked`` yet."""
        frame = self.numbers if checked else self.frame.select(*[c for c in self.frame.columns if not c.startswith(("_o", "_t"))])
        if self.near is not None:
            return fold_here(self.near.select(frame.columns), start, step)
        return fold(frame, self.parts, start, step, merge)

    def fold_ordered(self, start: Callable, step: Callable, merge: Callable):
        """A pass over ``ordered`` rows."""
        if self.near is not None:
            table = self.near.sort_by([(c, "ascending") for c in self.order]) if self.time else self.near
            return fold_here(table.select([f"_{i}" for i in range(len(self.numeric))]), start, step)
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if self.time else self.parts
        return fold(self.ordered(), parts, start, step, merge)

    @property
    def order(self) -> list[str]:
        """Time, the tie columns and then all others, which settle what those leave open, so that a fit repeats exactly."""
        at = "_t" if "_t" in self.frame.columns else f"_{len(self.columns) + bool(self.weight)}"
        return [at, *[f"_o{i}" for i in range(len(self.ties))], *[f"_{i}" for i in range(len(self.numeric)) if f"_{i}" != at]]

    @cached_property
    def parts(self) -> int | None:
        """The number of partitions; None where the data have to be shuffled first, and asking would run that."""
        plan = self.numbers._jdf.queryExecution().executedPlan().toString()
        return None if "Exchange" in plan else self.numbers.rdd.getNumPartitions()

    def ordered(self) -> DataFrame:
        """Sorted by time over range partitions; in the order of the source where no time is given."""
        if not self.time:
            return self.numbers
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.frame.repartitionByRange(n, *self.order).sortWithinPartitions(*self.order).select(*[f"_{i}" for i in range(len(self.numeric))])
