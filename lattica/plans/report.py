"""From findings to a decision: suppression, audits, coverage and the exit code."""

import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, joins
from ..sources.policy import RULES, load_policy
from ..sources.scan import inline_ignores, scan
from ..storage import written
from .facts import Catalog
from .rules import evaluate

SUPPRESSING = ("allow", "entrypoint", "factory", "lazy_import", "security_wrapper")
ALL_ZONES = ["prod", "test", "migration", "script"]


def approvals_table(spark: SparkSession, policy: dict) -> DataFrame:
    rows = [(a["rule"], a["symbol"], a.get("target"), z, a["reason"]) for a in policy["approvals"] if a.get("kind", "allow") in SUPPRESSING for z in a.get("zones", ALL_ZONES)]
    return spark.createDataFrame(rows, "rule_id string, approved string, target string, zone string, why string")


def suppress(findings: DataFrame, ignores: DataFrame, approvals: DataFrame) -> DataFrame:
    """findings with disposition (active or ignored) and reason: an inline ignore on the line, else an approval of the
    rule and symbol (the finding's subject or module) in the zone, for its target if the approval names one."""
    ours = ignores.where("issue IS NULL").select("path", "line", "rule_id", F.lit("inline ignore").alias("why"))
    exact = approvals.where("target IS NOT NULL").select("rule_id", F.col("approved").alias("subject"), F.col("target").alias("symbol"), "zone", "why")
    broad = approvals.where("target IS NULL")
    tables = [(ours, ["path", "line", "rule_id"], "why"), (exact, ["rule_id", "subject", "symbol", "zone"], "why"), *((broad.select("rule_id", F.col("approved").alias(x), "zone", "why"), ["rule_id", x, "zone"], "why") for x in ("subject", "symbol", "module_id"))]
    t = joins.precedence_lookup(findings, *tables)
    return t.withColumn("disposition", F.when(F.col("source").isNull(), "active").otherwise("ignored"))


def unused_ignores(ignores: DataFrame, findings: DataFrame) -> DataFrame:
    return joins.unmatched(ignores.where("issue IS NULL"), findings, ["path", "line", "rule_id"])


class Report:
    """The outcome of a check; every part is a DataFrame."""

    def __init__(self, catalog: Catalog, evaluations: DataFrame, findings: DataFrame, ignores: DataFrame, issues: DataFrame):
        self.catalog, self.ignores = catalog, ignores
        self.evaluations = written(evaluations)
        self.findings = written(suppress(findings, ignores, approvals_table(catalog.spark, catalog.policy)))
        unused = unused_ignores(ignores, self.findings)
        self.unused_ignores = unused
        self.issues = written(issues.union(ignores.where("issue IS NOT NULL").select(F.col("issue").alias("code"), "path", F.concat(F.lit("line "), (F.col("line") + 1).cast("string")).alias("message"))))

    @property
    def coverage(self) -> DataFrame:
        return aggregates.verdict_counts(self.evaluations, ["rule_id"])

    @property
    def resolution(self) -> DataFrame:
        return aggregates.resolution_coverage(self.catalog.kind("call"))

    @property
    def exit_code(self) -> int:
        judged = self.findings.select(F.lit("fail").alias("verdict"), "level", "disposition").union(self.evaluations.where("verdict = 'indeterminate'").select("verdict", "level", F.lit("active")))
        extra = self.unused_ignores.select(F.lit("fail"), F.lit("enforced"), F.lit("active"))
        return aggregates.exit_code(judged.union(extra), self.issues).first()[0]

    def to_json(self) -> str:
        """The whole report, sorted, the same bytes for the same sources and policy. Reports are small: one entry for each
        finding and rule."""
        order = ["path", "line", "column", "rule_id", "fingerprint"]
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        shown = self.findings.select("rule_id", "level", "module_id", "path", (F.col("line") + 1).alias("line"), (F.col("column") + 1).alias("column"), "symbol", "subject", "disposition", "reason", "fingerprint")
        return json.dumps({"schema_version": 5, "exit_code": self.exit_code, "findings": rows(shown.orderBy(*order)), "coverage": rows(self.coverage.orderBy("rule_id")), "issues": rows(self.issues.orderBy("path", "code", "message")), "resolution": rows(self.resolution)[0]}, sort_keys=True, indent=1)

    def to_text(self, width: int = 100) -> str:
        """Active findings, a paragraph each, wrapped to a terminal of so many columns."""
        found = self.findings.where("disposition = 'active'").orderBy("path", "line", "column", "rule_id", "fingerprint").collect()
        lines = [line for r in found for line in wrapped(f"{r['path']}:{r['line'] + 1}:{r['column'] + 1}: {r['rule_id']} {r['symbol']} ({r['subject']})", width)]
        return "\n".join([*lines, f"exit code {self.exit_code}"])


def columns(text: str) -> int:
    """Terminal columns of a text: wide and full-width signs take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def wrapped(text: str, width: int, indent: str = "    ") -> list[str]:
    """Lines of at most `width` columns, cut between words where possible; later ones are indented."""
    lines, now = [], ""
    for word in text.split(" "):
        trial = f"{now} {word}" if now.strip() else now + word
        if columns(trial) <= width or not now.strip():
            now = trial
        else:
            lines.append(now)
            now = indent + word
    return [*lines, now]


def check_sources(sources: DataFrame, policy: dict, issues: DataFrame | None = None, rules: list[str] | None = None, facts: DataFrame | None = None) -> Report:
    """Checks sources (as scan() gives them) against a completed policy. facts: those of the sources, if they are known."""
    catalog = Catalog(sources, policy, facts)
    evaluations, findings = evaluate(catalog, rules)
    ignores = written(inline_ignores(catalog.sources, list(RULES)))
    known = catalog.issues if issues is None else issues.union(catalog.issues)
    conflicts = catalog.modules.where("role_conflict OR zone_conflict").select(F.lit("INVALID_CONFIGURATION").alias("code"), "path", F.lit("several roles or zones match").alias("message"))
    return Report(catalog, evaluations, findings, ignores, known.union(conflicts))


def check(spark: SparkSession, root: str, policy: dict | str | None = None, table: str = "lattica") -> Report:
    """Checks a source tree. policy: a completed policy, or the path of a TOML file, by default root's pyproject.toml."""
    if not isinstance(policy, dict):
        policy = load_policy(spark, policy or f"{root.rstrip('/')}/pyproject.toml", table)
    sources, issues = scan(spark, root, policy["source_roots"], policy["include"], policy["exclude"], policy["force_include"])
    return check_sources(written(sources), policy, issues)
