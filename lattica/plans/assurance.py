"""Is the check complete? Issues of a configuration that leaves sources out, names what isn't there, or misses a feature."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import glob_match
from .capabilities import VIEWS, model_names, sql_models, tortoise_models
from .report import SUPPRESSING, Report
from .rules import has_effect, inherits, one_of

FEATURES = ("api", "schema", "dto", "snapshot", "exception_registry", "enum", "database", "transaction", "external_calls", "security", "tests", "migrations", "scripts")
ISSUE = "code string, subject string, detail string"


def evidence(report: Report) -> DataFrame:
    """feature, subject: what shows that a feature is there."""
    c = report.catalog
    code = c.policy["code"]
    tag = lambda df, name, column: df.select(F.lit(name).alias("feature"), F.col(column).alias("subject"))
    calls, models = c.calls, model_names(c)
    parts = [
        tag(VIEWS["fastapi.endpoints"](c), "api", "symbol"),
        tag(models.where(one_of("role", code["schema_roles"])), "schema", "symbol"),
        tag(c.classes.where(one_of("role", code["dto_roles"])), "dto", "symbol"),
        tag(models.where(F.contains("name", F.lit("Snapshot"))), "snapshot", "symbol"),
        tag(inherits(c, c.classes, "symbol", code["exception_base_symbols"] or ["-"]), "exception_registry", "symbol"),
        tag(inherits(c, c.classes, "symbol", ["enum.Enum", "enum.StrEnum", "enum.IntEnum"]), "enum", "symbol"),
        tag(sql_models(c), "database", "symbol"),
        tag(tortoise_models(c), "database", "symbol"),
        tag(calls.where(has_effect("tx.commit") | has_effect("tx.rollback") | one_of("canonical", c.policy["tx"]["session_providers"])), "transaction", "owner"),
        tag(calls.where(has_effect("external.call")), "external_calls", "owner"),
        tag(calls.where(has_effect("security.environment") | has_effect("security.secret") | has_effect("security.token")), "security", "owner"),
        *(tag(c.modules.where(F.col("zone") == zone), name, "path") for zone, name in (("test", "tests"), ("migration", "migrations"), ("script", "scripts"))),
    ]
    return reduce(DataFrame.union, parts).distinct()


def misplaced(report: Report) -> DataFrame:
    """path, role, shows: modules of production whose endpoints or database models their role is not for."""
    c = report.catalog
    parts = [
        VIEWS["fastapi.endpoints"](c).select("path", F.lit("endpoint").alias("shows"), F.lit("router").alias("key")),
        sql_models(c).select("path", F.lit("SQLAlchemy model"), F.lit("model")),
        tortoise_models(c).select("path", F.lit("Tortoise model"), F.lit("model")),
    ]
    fits = F.when(F.col("key") == "router", one_of("role", c.policy["code"]["router_roles"])).otherwise(one_of("role", c.policy["boundaries"]["model_roles"]))
    placed = reduce(DataFrame.union, parts).distinct().join(c.modules.where("zone = 'prod'").select("path", "role"), "path")
    return placed.where(~F.coalesce(fits, F.lit(False))).select("path", "role", "shows")


def policy_symbols(policy: dict) -> list[tuple[str, str]]:
    """(symbol, what it has to be) of the symbols that switch rules on."""
    tx, b, code = policy["tx"], policy["boundaries"], policy["code"]
    required = {k for k, v in policy["assurance"].get("features", {}).items() if v == "required"}
    calls = [tx["session_providers"], tx["boundary_decorators"], tx["boundary_contexts"], b["raw_query_wrappers"], b["external_call_wrappers"], b["settings_constructors"], code["test_http_fixture_symbols"]]
    classes = [b["adapter_implementation_symbols"], b["session_type_symbols"]]
    values: list[list[str]] = []
    if "schema" in required:
        values += [code["request_config_symbols"], code["response_config_symbols"]]
    if "exception_registry" in required:
        classes += [code["exception_base_symbols"], code["error_code_enum_symbols"]]
    return sorted({(s, kind) for kind, lists in (("callable", calls), ("class", classes), ("value", values)) for names in lists for s in names})


def audit(report: Report) -> DataFrame:
    """code, subject and detail of every issue; none means that the setup is complete."""
    c, p, spark = report.catalog, report.catalog.policy, report.catalog.spark
    issue = lambda df, code, subject, detail="": df.select(F.lit(code).alias("code"), F.col(subject).cast("string").alias("subject"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    paths, live = c.all_sources.select("path", "status"), c.modules
    parts = []
    excluded = [pattern for x in p["exclusions"] for pattern in x["patterns"]]
    noise = "(^|/)(\\.git|\\.venv|venv|__pycache__|node_modules|build|dist|\\.[a-z_]+_cache)(/|$)"
    parts.append(issue(paths.where((F.col("status") == "excluded") & ~glob_match(F.col("path"), excluded) & ~F.col("path").rlike(noise)), "SOURCE_UNACCOUNTED", "path"))

    def unused(code: str, named: list[tuple[str, list[str]]], among: DataFrame) -> None:
        """Selectors are configuration: one aggregate over the paths tells which of them match anything."""
        if named:
            hits = among.agg(*(F.coalesce(F.bool_or(glob_match(F.col("path"), globs)), F.lit(False)).alias(f"h{k}") for k, (_, globs) in enumerate(named)))
            rows_ = hits.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"h{k}").alias("hit")) for k, (name, _) in enumerate(named)))).alias("r")).select("r.*")
            parts.append(issue(rows_.where("NOT hit"), code, "name"))

    unused("EXCLUSION_UNUSED", [(g, [g]) for g in excluded], paths)
    unused("ROLE_SELECTOR_UNUSED", [(r["name"], r["include"]) for r in p["roles"]], live)
    unused("ZONE_SELECTOR_UNUSED", [(z["name"], z["patterns"]) for z in p["zones"]], live)
    parts.append(issue(live.where("role IS NULL"), "ROLE_UNCLASSIFIED", "path"))
    seen = evidence(report)
    settings = p["assurance"].get("features", {})
    if settings:
        wanted = spark.createDataFrame([(k, settings.get(k, "")) for k in FEATURES], "feature string, expectation string")
        counts = seen.groupBy("feature").agg(F.count("*").alias("n"), F.min("subject").alias("first"))
        t = wanted.join(counts, "feature", "left")
        parts.append(issue(t.where("expectation = 'required' AND n IS NULL"), "FEATURE_REQUIRED_MISSING", "feature"))
        parts.append(issue(t.where("expectation = 'absent' AND n > 0"), "FEATURE_ABSENT_DETECTED", "feature", F.col("first")))
        parts.append(issue(t.where("expectation = ''"), "FEATURE_UNDECIDED", "feature"))
    used = report.findings.where("disposition = 'ignored'")
    approvals = [(f"{a['rule']}:{a['symbol']}", a["rule"], a["symbol"]) for a in p["approvals"] if a.get("kind", "allow") in SUPPRESSING]
    if approvals:
        table = spark.createDataFrame(approvals, "key string, rule_id string, approved string")
        hit = used.select("rule_id", F.explode(F.array("symbol", "subject", "module_id")).alias("approved")).distinct()
        parts.append(issue(table.join(hit, ["rule_id", "approved"], "left_anti"), "APPROVAL_UNUSED", "key"))
    counts = used.agg(F.count_if(F.col("reason") != "inline ignore").alias("a"), F.count_if(F.col("reason") == "inline ignore").alias("i"))
    parts.append(issue(counts.where(F.col("a") > p["assurance"].get("max_approvals", 0)), "APPROVAL_BUDGET_EXCEEDED", "a"))
    parts.append(issue(counts.where(F.col("i") > p["assurance"].get("max_inline_ignores", 0)), "IGNORE_BUDGET_EXCEEDED", "i"))
    parts.append(issue(misplaced(report), "ROLE_SEMANTIC_MISMATCH", "path", F.concat(F.col("shows"), F.lit(" in role "), F.coalesce("role", F.lit("none")))))
    named = policy_symbols(p)
    if named:
        roots = live.select(F.split_part("module_id", F.lit("."), F.lit(1)).alias("root")).distinct()
        table = spark.createDataFrame(named, "symbol string, wanted string").withColumn("root", F.split_part("symbol", F.lit("."), F.lit(1))).join(roots, "root", "left_semi")
        made = c.facts.where("kind IN ('function', 'class', 'field')").select("symbol", "kind")
        used = c.facts.where("kind IN ('call', 'decorator') AND symbol IS NOT NULL").select("symbol", "kind").union(c.aliases.select("alias", F.lit("alias")))
        kinds = made.union(used).groupBy("symbol").agg(F.collect_set("kind").alias("kinds"))
        t = table.join(kinds, "symbol", "left")
        parts.append(issue(t.where("kinds IS NULL").select("symbol").distinct(), "POLICY_SYMBOL_UNRESOLVED", "symbol"))
        has = lambda *some: F.arrays_overlap("kinds", F.array(*map(F.lit, some)))
        fits = F.when(F.col("wanted") == "class", has("class", "alias")).when(F.col("wanted") == "value", has("field", "alias")).otherwise(has("function", "class", "alias"))
        parts.append(issue(t.where(~fits), "POLICY_SYMBOL_KIND_MISMATCH", "symbol", F.concat(F.lit("no "), F.col("wanted"))))
    return reduce(DataFrame.union, parts)


def observe(report: Report) -> dict[str, DataFrame]:
    """What a first policy can be made of: edges between roles, size limits by role, and features with their evidence."""
    from ..operators.aggregates import size_limits

    c = report.catalog
    role = lambda name: c.modules.select(F.col("module_id").alias(name), F.col("role").alias(f"{name}_role"))
    edges = c.import_edges.where("NOT type_only").join(role("importer"), "importer").join(role("target"), "target")
    return {
        "role_edges": edges.where("importer_role IS NOT NULL AND target_role IS NOT NULL").groupBy("importer_role", "target_role").agg(F.count_distinct("importer", "target").alias("edges")),
        "size_limits": size_limits(c.modules.where("role IS NOT NULL"), ["role"], "line_count"),
        "features": evidence(report).groupBy("feature").agg(F.count("*").alias("evidence"), F.min("subject").alias("first")),
    }
