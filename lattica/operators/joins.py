"""Joins that Spark has no operator for, as equi joins with a bounded remainder."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def containment_join(outer: DataFrame, inner: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows with equal `by` where the outer range holds the inner one (outer.start <= inner.start and inner.end <=
    outer.end). Columns of both, those of inner other than `by` with the prefix inner_. Positions are whole numbers.

    Ranges have levels, the powers of two above their lengths. At its level an outer range lies in one bucket or two, an
    inner one is dealt to the bucket of its start at each level that outer ranges have (64 at most), so the join is an equi
    join on (by, level, bucket), a pair meets once, and a row is copied a bounded number of times however wide it is."""
    low, high = F.col(start).cast("long"), F.col(end).cast("long")
    ranges = outer.where(low <= high).withColumn("_level", F.length(F.bin(high - low)))
    levels = sorted(r[0] for r in ranges.select("_level").distinct().collect())  # 64 at most
    bucket = lambda x, level: F.expr(f"shiftright({x}, {level})")
    spread = ranges.withColumns({"_s": low, "_e": high})
    spread = spread.withColumn("_b", F.explode(F.array_distinct(F.array(bucket("_s", "_level"), bucket("_e", "_level"))))).drop("_s", "_e")
    narrow = inner.select(*by, *[F.col(c).alias(f"inner_{c}") for c in inner.columns if c not in by], low.alias("_s"))
    each = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    narrow = narrow.withColumn("_level", F.explode(each)).withColumn("_b", bucket("_s", "_level")).drop("_s")
    return spread.join(narrow, [*by, "_level", "_b"]).where((F.col(f"inner_{start}") >= F.col(start)) & (F.col(f"inner_{end}") <= F.col(end))).drop("_b", "_level")


def nearest_left(left: DataFrame, right: DataFrame, by: list[str], at: str, pick: str) -> DataFrame:
    """left with `pick` of the row of right that has equal `by` and the largest `at` not above left's (an as-of join); of
    several such rows the largest pick. Null where there is none.

    Both sides are laid on one axis and the last right row is carried forward, so the cost is one sort, whatever the
    number of matches."""
    kind = right.schema[pick].dataType
    a = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_pick"), F.struct(*left.columns).alias("_row"))
    b = right.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(pick).alias("_pick"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    axis = Window.partitionBy(*by).orderBy("_at", "_side", "_pick").rowsBetween(Window.unboundedPreceding, 0)
    return a.union(b).withColumn("_last", F.last("_pick", ignorenulls=True).over(axis)).where("_side = 1").select("_row.*", F.col("_last").alias(pick))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed or changed) of the keys on which the two tables differ; nulls are equal."""
    a, b = before.select(F.col(key), F.struct(F.col(value)).alias("_a")), after.select(F.col(key), F.struct(F.col(value)).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).where("change IS NOT NULL")


def precedence_lookup(rows: DataFrame, *tables: tuple[DataFrame, list[str], str]) -> DataFrame:
    """rows with source (number of the first table that has the row's values, from 0, null if none) and reason.

    Each table is (DataFrame, columns that must equal those of rows, reason column). Of several rows in a table the
    smallest reason counts; tables are reduced to one row for each key before the join."""
    out, sources, reasons = rows, [], []
    for n, (table, on, reason) in enumerate(tables):
        small = table.groupBy(*on).agg(F.min(reason).alias(f"_r{n}"), F.lit(True).alias(f"_s{n}"))
        out = out.join(small, on, "left")
        sources.append(F.when(F.col(f"_s{n}"), n))
        reasons.append(F.when(F.col(f"_s{n}"), F.struct(F.col(f"_r{n}").alias("r"))))
    made = [c for n in range(len(tables)) for c in (f"_r{n}", f"_s{n}")]
    return out.withColumn("source", F.coalesce(*sources)).withColumn("reason", F.coalesce(*reasons)["r"]).drop(*made)


def unmatched(rows: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """The rows that nothing used."""
    return rows.join(used.select(*on).distinct(), on, "left_anti")


def bind_arguments(calls: DataFrame, parameters: DataFrame) -> DataFrame:
    """call_id, parameter, value: which argument each parameter of a call's function gets; calls that can't be bound
    (too many or unknown arguments, one given twice, a required one missing) bind nothing.

    calls: call_id, function, args array<struct<name, position, value>> (name is null for positional ones).
    parameters: function, name, position, kind (positional_only, positional_or_keyword, var_positional, keyword_only,
    var_keyword), required."""
    c = calls.select("call_id", "function", "args")
    given = c.select("call_id", "function", F.explode("args").alias("a")).select("call_id", "function", F.col("a.name").alias("arg"), F.col("a.position").alias("at"), F.col("a.value").alias("value"))
    p = parameters.select("function", F.col("name").alias("parameter"), F.col("position").alias("slot"), "kind", "required")
    plain = p.where("kind IN ('positional_only', 'positional_or_keyword')")
    by_place = given.where("arg IS NULL").join(plain, ["function"]).where("at = slot")
    by_name = given.where("arg IS NOT NULL").join(p.where("kind IN ('positional_or_keyword', 'keyword_only')"), ["function"]).where("arg = parameter")
    hit = by_place.union(by_name).select("call_id", "function", "parameter", "arg", "at", "value")
    twice = hit.groupBy("call_id", "parameter").agg(F.count("*").alias("n")).where("n > 1").select("call_id")
    spare = p.groupBy("function").agg(F.bool_or(F.col("kind") == "var_positional").alias("more"), F.bool_or(F.col("kind") == "var_keyword").alias("named"))
    rest = given.join(hit.select("call_id", F.col("arg").alias("_arg"), F.col("at").alias("_at")), (given["call_id"] == hit["call_id"]) & given["arg"].eqNullSafe(F.col("_arg")) & given["at"].eqNullSafe(F.col("_at")), "left_anti")
    bad = rest.join(spare, "function", "left").where("NOT coalesce(CASE WHEN arg IS NULL THEN more ELSE named END, false)").select("call_id")
    need = c.join(p.where("required"), "function").select("call_id", "parameter").join(hit, ["call_id", "parameter"], "left_anti").select("call_id")
    return hit.join(twice.union(bad).union(need).distinct(), "call_id", "left_anti").select("call_id", "parameter", "value")


def overlaps(column: Column, wanted: list[str]) -> Column:
    """An array column shares a value with a fixed set."""
    return F.arrays_overlap(column, F.array(*map(F.lit, wanted))) if wanted else F.lit(False)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows that one of the tables has and the other has not; nulls are equal."""
    a = a.select(*b.columns)
    return a.subtract(b).union(b.subtract(a))
