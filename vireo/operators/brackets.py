"""Look-ups in tables of knots that are rows: each value finds the knots around it by one sort, without a join of ranges.

Values and knots are one relation, cut into ranges of the look-up's variable; within a range a window carries the last knot forward and
the next one backward, and what lies beyond its border comes from a small table with one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vireo.operators.numbering import ranges


def _around(rows: DataFrame, by: list[str], held: Column) -> DataFrame:
    """rows (by, _range, _x, _knot, ...) with _last, the last non-null ``held`` before each, and _next, the first at or after it.

    At equal _x a knot comes after the values, so that a value at a knot has it as its next one.
    """
    rows = rows.withColumn("_held", held)
    own = Window.partitionBy(*by, "_range")
    before = own.orderBy("_x", "_knot").rowsBetween(Window.unboundedPreceding, -1)
    # the other way round: a window up to the end is gone through again for each of its rows
    after = own.orderBy(F.desc("_x"), F.desc("_knot")).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"_last": F.last("_held", True).over(before), "_next": F.last("_held", True).over(after)})
    # each range's own last and first knot, carried over the ranges: at most one row a key and range
    ends = rows.where(F.col("_held").isNotNull()).groupBy(*by, "_range").agg(F.max_by("_held", "_x").alias("_end"), F.min_by("_held", "_x").alias("_begin"))
    spans = rows.select(*by, "_range").distinct().join(ends, [*by, "_range"], "left")
    over = Window.partitionBy(*by).orderBy("_range")
    spans = spans.select(*by, "_range", F.last("_end", True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_until"), F.first("_begin", True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_from"))
    joined = placed.join(spans, [*by, "_range"], "left")  # null keys have no knots
    return joined.withColumns({"_last": F.coalesce("_last", "_until"), "_next": F.coalesce("_next", "_from")}).drop("_until", "_from", "_held")


def looked_up(rows: DataFrame, knots: DataFrame, x: str, knot: str, values: list[str], by: list[str] = [], above: bool = True) -> DataFrame:
    """rows with ``values`` of the knots, linear in x: held below the first knot, and above the last one continued or held.

    knots: by, knot and values; keys are the columns ``by`` of both sides.  No row is left out: a key without knots, as a null one is,
    gives nulls, and so does a null x, but among the values of a single knot, which hold everywhere.  All rows of knots count but
    those whose knot or key is null: where a knot is repeated, the greatest of each of its values that aren't null.
    """
    for c in (knot, *by):
        knots = knots.where(F.col(c).isNotNull())
    table = knots.groupBy(*by, F.col(knot).cast("double").alias("_x")).agg(*(F.max(F.col(v).cast("double")).alias(v) for v in values))
    table = table.select(*by, "_x", F.struct(F.col("_x").alias("k"), *values).alias("_k"))
    key = [*by] or ["_all"]
    if not by:
        table = table.withColumn("_all", F.lit(0))
        rows = rows.withColumn("_all", F.lit(0))
    # each knot with the one before it
    table = table.withColumns({"_range": ranges(table, "_x"), "_knot": F.lit(1)})
    table = _around(table, key, F.col("_k")).select(*key, "_x", F.struct("_k", F.col("_last").alias("_p")).alias("_pair"))
    # a null x comes last, where the one before a single knot is seen to be missing
    bounds = ranges(rows.select(F.col(x).cast("double").alias("_x")), "_x")
    packed = rows.select(*key, F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))).alias("_x"), F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "_all")).alias("_row"))
    both = packed.withColumn("_pair", F.lit(None).cast(table.schema["_pair"].dataType)).unionByName(table.withColumn("_row", F.lit(None).cast(packed.schema["_row"].dataType)))
    both = both.withColumns({"_range": bounds, "_knot": F.when(F.col("_pair").isNull(), 0).otherwise(1)})
    found = _around(both, key, F.col("_pair")).where("_knot = 0")
    pair = F.coalesce("_next", "_last")
    beyond = F.col("_next").isNull()

    def value(v: str) -> Column:
        at, before = pair["_k"], pair["_p"]
        line = before[v] + (F.col("_x") - before["k"]) * ((at[v] - before[v]) / (at["k"] - before["k"] + 1e-6))
        made = F.when(before.isNull() | (F.lit(not above) & beyond), at[v]).otherwise(line)
        return F.when(F.col("_row")[x].isNotNull() | before.isNull(), made).alias(v)

    return found.select("_row.*", *map(value, values))
