"""Aggregations of checks: counts by verdict and state, duplicates, budgets, decisions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("pass", "fail", "not_applicable", "indeterminate")
STATES = ("resolved", "conditional", "unresolved", "ambiguous", "dynamic")


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def verdict_counts(evaluations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A count for each verdict, and total."""
    return evaluations.groupBy(*(by or [])).agg(*(count_where(F.col("verdict") == v, v) for v in VERDICTS), F.count("*").alias("total"))


def resolution_coverage(facts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A count for each state of resolution."""
    return facts.groupBy(*(by or [])).agg(*(count_where(F.col("state") == s, s) for s in STATES))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key occurs more than once; keys are counted before the join, so a hot key is not sorted."""
    often = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(often, key, "left_semi")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order; null order values come last."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))]))
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, "_b.*")


def last_of(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """key and the value of its last row in order."""
    return rows.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value))


def size_limits(files: DataFrame, by: list[str], size: str, headroom: float = 1.2, floor: int = 200, step: int = 50, cap: int = 700) -> DataFrame:
    """max_lines of each group: the nearest-rank 95th percentile with headroom, rounded up to a step, between floor and
    cap."""
    p95 = F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {size})")
    wide = F.ceil(F.col("p95") * headroom / step) * step
    return files.groupBy(*by).agg(p95.alias("p95")).select(*by, F.least(F.greatest(wide, F.lit(floor)), F.lit(cap)).cast("long").alias("max_lines"))


def saturating_sum(column: str, most: int = 2) -> Column:
    return F.least(F.sum(column), F.lit(most))


def common_members(rows: DataFrame, key: list[str], owner: str, member: str) -> DataFrame:
    """key, member: what all owners of a key have (the intersection of their sets)."""
    owners = rows.groupBy(*key).agg(F.countDistinct(owner).alias("_all"))
    return rows.where(F.col(member).isNotNull()).groupBy(*key, member).agg(F.countDistinct(owner).alias("_n")).join(owners, key).where("_n = _all").select(*key, member)


def merge_effects(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, effects, direct (bit masks) joined; an effect reached directly stays direct."""
    return rows.groupBy(*key).agg(F.bit_or("effects").alias("effects"), F.bit_or("direct").alias("direct"))


def exit_code(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """One row, exit_code: 2 if anything makes the result unreliable (an issue, or an enforced indeterminate verdict),
    else 1 if an enforced active violation exists, else 0.

    findings: verdict, level, disposition. issues: any rows count."""
    a = findings.agg(F.count_if(F.expr("verdict = 'indeterminate' AND level = 'enforced'")).alias("doubt"), F.count_if(F.expr("verdict = 'fail' AND level = 'enforced' AND disposition = 'active'")).alias("bad"))
    b = issues.agg(F.count("*").alias("issues"))
    code = F.when((F.col("issues") > 0) | (F.col("doubt") > 0), 2).when(F.col("bad") > 0, 1).otherwise(0)
    return a.crossJoin(b).select(code.cast("int").alias("exit_code"))  # one row with one row


def completeness_counts(modules: DataFrame, by: list[str] | None = None) -> DataFrame:
    """complete, incomplete and total of modules (complete boolean; null counts as incomplete)."""
    known = F.coalesce("complete", F.lit(False))
    return modules.groupBy(*(by or [])).agg(count_where(known, "complete"), count_where(~known, "incomplete"), F.count("*").alias("total"))


def spread(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """median (between the middle ones), p95 (nearest rank) and largest of a column, exactly."""
    return rows.groupBy(*by).agg(F.percentile(column, F.lit(0.5)).alias("median"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {column})").alias("p95"), F.max(column).alias("largest"))


def every(condition: Column) -> Column:
    """Whether all members of a group fulfil the condition; a group without members does."""
    return F.coalesce(F.bool_and(condition), F.lit(True))


def confusion(cases: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, precision and recall of cases (violation boolean, observed string); ratios that aren't
    defined are null."""
    said, is_ = F.col("observed") == "violation", F.col("violation")
    t = cases.agg(count_where(said & is_, "tp"), count_where(said & ~is_, "fp"), count_where(~said & is_, "fn"), count_where(~said & ~is_, "tn"))
    return t.withColumn("precision", F.try_divide("tp", F.col("tp") + F.col("fp"))).withColumn("recall", F.try_divide("tp", F.col("tp") + F.col("fn")))


def evict(entries: DataFrame, now: Column, max_age: int, capacity: int, slices: int = 1) -> DataFrame:
    """The entries (id, bytes, accessed in seconds) that go: those older than max_age, then the least recently used ones
    until the rest fit into capacity.

    The running sum needs one order over all entries. It is made in two steps, sums of slices of the time axis and sums
    inside a slice, so no task holds all rows; slices: seconds of a slice."""
    fresh = entries.withColumn("_old", F.col("accessed") < now - max_age)
    young = fresh.where("NOT _old").withColumn("_s", F.floor(F.col("accessed") / slices))
    sums = young.groupBy("_s").agg(F.sum("bytes").alias("_b"))
    before = sums.select("_s", (F.sum("_b").over(Window.orderBy(F.desc("_s"))) - F.col("_b")).alias("_newer"))
    inside = Window.partitionBy("_s").orderBy(F.desc("accessed"), F.desc("id"))
    held = young.join(before, "_s").withColumn("_upto", F.col("_newer") + F.sum("bytes").over(inside))
    return fresh.where("_old").select(*entries.columns).union(held.where(F.col("_upto") > capacity).select(*entries.columns))
