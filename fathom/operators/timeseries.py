"""Rolling windows and downsampling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ValidationError
from ..sources.shared import checked, written

_FUNCTIONS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
#: Columns that may hold a row's time, in order of preference.
TIMES = ("timestamp", "ts", "created_at", "time")
#: Rows of a block of a rolling window over a whole table.
BLOCK = 1 << 16


def seconds(interval: str) -> int:
    """30s, 5m, 2h, 1d, or a number of seconds."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(interval))
    n = int(m[1]) * {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]] if m else 0
    if n <= 0:
        raise ValidationError(f"no interval: {interval!r}")
    return n


def function(name: str):
    key = name.removeprefix("rolling").lower() if name.startswith("rolling") else name.lower()
    if key not in _FUNCTIONS:
        raise ValidationError(f"unknown window function {name}")
    return _FUNCTIONS[key]


def rolling(df: DataFrame, columns: dict[str, tuple[str, str, int]], order: list[Column], bounded: bool) -> DataFrame:
    """df with a column for each (field, function, rows), over a row and the rows - 1 before it.

    A bounded table (after a limit) is one window.  Any other is numbered along
    `order` and cut into blocks; each block also gets the last rows of the one before
    it, so blocks are computed apart and nothing passes through a single task.
    """
    for field, name, rows in columns.values():
        if field not in df.columns:
            raise ValidationError(f"unknown field {field}")
        if rows < 1:
            raise ValidationError("windowSize must be positive")
        function(name)
    if bounded:
        w = Window.orderBy(*order)
        return df.withColumns({a: _over(c, w) for a, c in columns.items()})
    halo = max(rows for _, _, rows in columns.values()) - 1
    block = max(BLOCK, 2 * halo)
    numbered = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__n", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("__n", 33)
    # A row for each partition, with the rows before it.
    sizes = numbered.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__of"))
    before = sizes.withColumn("__first", F.coalesce(F.sum("__of").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__of")
    before = written(before)
    numbered = numbered.withColumn("__p", part).join(checked(before, before.count(), 24), "__p")
    numbered = numbered.withColumn("__n", F.col("__first") + F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__first")
    own = F.floor(F.col("__n") / block).cast("long")
    again = F.col("__n") % block >= block - halo if halo else F.lit(False)
    blocks = F.when(again, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("__b", F.explode(blocks))
    w = Window.partitionBy("__b").orderBy("__n")
    out = spread.withColumns({a: _over(c, w) for a, c in columns.items()})
    return out.filter(F.floor(F.col("__n") / block) == F.col("__b")).drop("__n", "__b")


def _over(column: tuple[str, str, int], w) -> Column:
    field, name, rows = column
    return function(name)(F.col(f"`{field}`").cast("double")).over(w.rowsBetween(-(rows - 1), 0))


def epoch(df: DataFrame, name: str | None = None) -> Column:
    """Seconds since 1970 of a row, by the first time column there is."""
    for n in [name] if name else TIMES:
        if n in df.columns:
            kind, c = df.schema[n].dataType, F.col(f"`{n}`")
            if isinstance(kind, T.StringType):
                return F.unix_seconds(F.try_to_timestamp(c))
            return F.unix_seconds(c.cast("timestamp")) if isinstance(kind, T.DatetimeType) else c.cast("long")
    raise ValidationError("no time column")


def bucket(at: Column, width: int) -> Column:
    return F.timestamp_seconds(F.floor(at / width).cast("long") * width).cast("timestamp_ntz")


def downsample(df: DataFrame, interval: str, aggregation: str, fields: list[tuple[str, str]]) -> DataFrame:
    """A row (timestamp, count, fields) for each interval with rows; rows without a time have none.  fields: (field, name of the output)."""
    if aggregation not in ("avg", "sum", "min", "max", "count"):
        raise ValidationError(f"unknown aggregation {aggregation}")
    at = epoch(df)
    outs = []
    for name, out in fields:
        if name not in df.columns:
            raise ValidationError(f"unknown field {name}")
        c = F.col(f"`{name}`")
        outs.append((F.count(c).cast("double") if aggregation == "count" else _FUNCTIONS[aggregation](c.try_cast("double"))).alias(out))
    return df.filter(at.isNotNull()).groupBy(bucket(at, seconds(interval)).alias("timestamp")).agg(F.count(F.lit(1)).alias("count"), *outs)
