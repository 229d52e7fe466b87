"""Identities that are the same on every run: hashes of canonical text."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sha256(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by a zero byte; a null part is empty."""
    joined = F.concat_ws("\0", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts))
    return F.sha2(joined.cast("binary"), 256)


def fact_ids(facts: DataFrame, order: list[str]) -> DataFrame:
    """facts with fact_id: a hash of module_id, scope, kind, subject and the running number of the same four, so ids stay
    when lines move."""
    same = ["module_id", "scope", "kind", "subject"]
    number = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    return facts.withColumn("fact_id", sha256(*same, number.cast("string")))


def canonical_json(row: Column) -> Column:
    """JSON of a struct with nulls written out, so that missing and null stay apart from absent columns."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def finding_fingerprint(rule: str, version: str, module: str, symbol: str, subject: str, evidence: Column) -> Column:
    parts = F.struct(evidence.alias("evidence"), F.col(module).alias("module"), F.col(rule).alias("rule"), F.col(subject).alias("subject"), F.col(symbol).alias("symbol"), F.col(version).alias("version"))
    return F.sha2(canonical_json(parts).cast("binary"), 256)


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row, digest: of all rows in any order. Hashes of rows are summed by their halves, so no row moves."""
    h = F.sha2(canonical_json(F.struct(*columns)).cast("binary"), 256)
    words = [F.sum(F.conv(F.substr(h, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long")).alias(f"w{k}") for k in range(8)]
    sums = df.agg(F.count("*").alias("n"), *words)
    return sums.select(F.sha2(F.concat_ws(",", "n", *(F.coalesce(f"w{k}", F.lit(0)) for k in range(8))), 256).alias("digest"))
