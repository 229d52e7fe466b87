"""Checks that follow revisions: only what changed is read again, and the outcome equals a fresh check.

A session keeps the facts of the last revision as a table. A new revision is compared by content hashes; facts of changed
files are extracted, those of untouched ones are kept by an anti join, and all else is a plan over the two, so a rule never
sees a difference between kept and fresh facts. What is expensive, parsing, is proportional to the change.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import table_digest
from ..operators import graph, joins
from ..plans.facts import Catalog
from ..plans.report import Report, check_sources
from ..sources.extract import extract
from ..storage import written

SOURCE = "path string, module_id string, is_package boolean, content string, content_hash string, line_count int, status string"
#: Columns of facts that say where something stands, not what it is.
PLACES = ("n", "line", "column", "end_line", "end_column", "parent")


def change_set(before: DataFrame, after: DataFrame) -> DataFrame:
    """module_id and change (added, removed, changed) between two revisions of sources."""
    live = lambda df: df.where("status = 'analyzed'").select("module_id", F.concat_ws("\0", "path", "content_hash").alias("v"))
    return joins.snapshot_diff(live(before), live(after), "module_id", "v")


def impacted(changes: DataFrame, before: Catalog, after: Catalog) -> DataFrame:
    """node: changed modules and all that import them, directly or not, in either revision."""
    edges = lambda c: c.import_edges.select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()
    return graph.impact(changes.select(F.col("module_id").alias("node")), edges(before), edges(after))


def semantic_digests(facts: DataFrame) -> DataFrame:
    """module_id, digest: of all facts of a module without their places, in their order; equal for a file whose lines only
    moved."""
    plain = [c for c in facts.columns if c not in PLACES]
    text = F.to_json(F.struct(*[F.map_entries(c).alias(c) if c == "attrs" else F.col(c) for c in plain]), {"ignoreNullFields": "false"})
    each = facts.select("module_id", "n", F.sha2(text.cast("binary"), 256).alias("h"))
    return each.groupBy("module_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("digest"))


def missed(proposed: DataFrame, observed: DataFrame) -> DataFrame:
    """What changed but was not proposed for recomputation; empty if invalidation is sound."""
    return joins.unmatched(observed, proposed, observed.columns)


class Session:
    """Checks one revision after the other. A changed policy starts afresh."""

    def __init__(self, spark: SparkSession, policy: dict):
        self.spark, self.policy = spark, policy
        self.sources: DataFrame | None = None
        self.catalog: Catalog | None = None
        self.changes: DataFrame | None = None

    def facts(self, sources: DataFrame) -> DataFrame:
        if self.catalog is None:
            return written(extract(sources.where("status = 'analyzed'")))
        self.changes = written(change_set(self.sources, sources))
        touched = self.changes.select("module_id")
        kept = self.catalog.facts.join(touched, "module_id", "left_anti").select(*self.catalog.facts.columns)
        fresh = extract(sources.where("status = 'analyzed'").join(touched, "module_id", "left_semi"))
        return written(kept.union(fresh))

    def check(self, sources: DataFrame, issues: DataFrame | None = None) -> Report:
        sources = written(sources)
        report = check_sources(sources, self.policy, issues, facts=self.facts(sources))
        self.sources, self.catalog = sources, report.catalog
        return report

    def digest(self) -> str:
        return table_digest(self.catalog.facts.drop("attrs"), [c for c in self.catalog.facts.columns if c != "attrs"]).first()[0]


def follow(session: Session, revisions: DataFrame, to: str):
    """A streaming query over a stream of edits (revision long, path, module_id, is_package, content, deleted boolean): each
    micro-batch is applied to the sources and checked, and its active findings are appended to the table at `to`, marked
    with the batch. Of several edits of a path in one batch the last revision counts."""

    def apply(batch: DataFrame, number: int) -> None:
        last = written(batch.groupBy("path").agg(F.max_by(F.struct("module_id", "is_package", "content", "deleted"), "revision").alias("e")).select("path", "e.*"))
        text = F.coalesce("content", F.lit(""))
        new = last.where("NOT deleted").select("path", "module_id", "is_package", text.alias("content"), F.sha2(text.cast("binary"), 256).alias("content_hash"), (F.size(F.split(text, "\n")) - F.when(F.endswith(text, F.lit("\n")) | (text == ""), 1).otherwise(0)).cast("int").alias("line_count"), F.lit("analyzed").alias("status"))
        if session.sources is not None:
            new = session.sources.join(last, "path", "left_anti").select(*new.columns).union(new)
        report = session.check(new)
        found = report.findings.where("disposition = 'active'").select("rule_id", "module_id", "path", "line", "column", "symbol", "subject", "fingerprint")
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{to}/batch={number}")  # the same batch again gives the same rows

    return revisions.writeStream.foreachBatch(apply)
