"""A first policy for a project without one: what is observed, what is left to decide, and the proposal as TOML."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fingerprints import table_digest
from ..operators import graph
from ..operators.aggregates import size_limits
from ..sources.policy import complete
from ..sources.scan import scan
from ..storage import written
from .assurance import FEATURES, evidence
from .facts import Catalog
from .report import check_sources

# Directory names that tell a role, and roles into which imports are risky.
ALIASES = {
    "router": ["router", "routers", "api", "endpoints"],
    "service": ["service", "services"],
    "model": ["model", "models"],
    "schema": ["schema", "schemas"],
    "dto": ["dto", "dtos"],
    "adapter": ["adapter", "adapters", "clients", "gateways"],
    "query": ["query", "queries", "repositories"],
    "task": ["task", "tasks", "jobs"],
    "consumer": ["consumer", "consumers"],
    "configuration": ["config", "settings", "configuration"],
    "bootstrap": ["bootstrap", "composition"],
    "contract": ["contract", "contracts", "ports"],
}
ZONES = {"test": ["tests", "test"], "migration": ["migrations", "alembic"], "script": ["scripts"]}
RISKY = ("router", "bootstrap", "task", "consumer")


def project_digest(sources: DataFrame) -> str:
    """Of paths and contents; answers to an older one are stale."""
    return table_digest(sources.where("status <> 'excluded'"), ["path", "content_hash"]).first()[0]


def role_candidates(modules: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """path, directory, role, rank: the deepest directory with a telling name decides; two roles for one directory name are
    ranked by name."""
    known = aliases or ALIASES
    pairs = modules.sparkSession.createDataFrame([(a, r) for r, names in known.items() for a in names], "part string, role string")
    parts = F.split("path", "/")
    t = modules.select("path", parts.alias("_p"), F.posexplode(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("depth", "part"))
    t = t.join(F.broadcast(pairs), "part").select("path", "role", "depth", F.array_join(F.slice("_p", F.lit(1), F.col("depth") + 1), "/").alias("directory"))
    best = t.groupBy("path").agg(F.min_by(F.struct("directory", "role"), F.struct(-F.col("depth"), "role")).alias("b"), F.count_distinct("role").alias("roles"))
    return best.select("path", "b.directory", "b.role", F.when(F.col("roles") > 1, "conflict").otherwise("directory").alias("evidence"))


def propose(spark: SparkSession, root: str, answers: dict | None = None, table: str = "lattica") -> dict:
    """digest, roles, allow, risky (edges between roles that need a decision), limits, features, questions and toml.

    answers: {"project_digest", "risky": {"a>b": "allow" or "deny"}, "features": {name: "required" or "absent"}}; those of an
    older digest are refused."""
    sources, _ = scan(spark, root)
    sources = written(sources)
    digest = project_digest(sources)
    answers = answers or {}
    if answers and answers.get("project_digest") != digest:
        raise ValueError("the answers are for another state of the project")
    live = sources.where("status = 'analyzed'")
    candidates = written(role_candidates(live.select("path")))
    roles: dict[str, list[str]] = {}
    for r in candidates.select("role", "directory").distinct().orderBy("role", "directory").collect():
        roles.setdefault(r.role, []).append(f"{r.directory}/*")
    names = {p for r in live.select(F.explode(F.split("path", "/")).alias("p")).distinct().where(F.col("p").isin(*[n for v in ZONES.values() for n in v])).collect() for p in r}
    zones = {z: [g for n in own if n in names for g in (f"{n}/*", f"*/{n}/*")] for z, own in ZONES.items()}
    zones = {z: g for z, g in zones.items() if g}
    policy = complete({"roles": {r: {"include": p} for r, p in roles.items()}, "zones": zones})
    catalog = Catalog(sources, policy)
    role = lambda name: catalog.modules.select(F.col("module_id").alias(name), F.col("role").alias(f"{name}_role"))
    edges = catalog.import_edges.where("NOT type_only").join(role("importer"), "importer").join(role("target"), "target").where("importer_role IS NOT NULL AND target_role IS NOT NULL").select(F.col("importer_role").alias("src"), F.col("target_role").alias("dst")).distinct()
    pairs = sorted(map(tuple, written(edges).collect()))  # pairs of roles: few, whatever the project's size
    back = {(r.src, r.dst) for r in graph.closure(edges).collect()} if pairs else set()
    risky = [(a, b) for a, b in pairs if a != b and (b in RISKY or (b, a) in back)]
    decided = answers.get("risky", {})
    allow = {r: sorted({r, *(b for a, b in pairs if a == r and ((a, b) not in risky or decided.get(f"{a}>{b}") == "allow"))}) for r in roles}
    limits = {r.role: r.max_lines for r in size_limits(catalog.modules.where("role IS NOT NULL"), ["role"], "line_count").orderBy("role").collect()}
    seen = {r.feature for r in evidence(check_sources(sources, policy, rules=[], facts=catalog.facts)).select("feature").distinct().collect()}
    features = {f: answers.get("features", {}).get(f) or ("required" if f in seen else "absent") for f in FEATURES}
    questions = [f"decide {a}>{b}" for a, b in risky if f"{a}>{b}" not in decided]
    questions += [f"role of {r.path}" for r in live.select("path", "is_package").join(candidates.select("path"), "path", "left_anti").where("NOT is_package").orderBy("path").collect() if not any(n in r.path.split("/") for v in ZONES.values() for n in v)]
    questions += [f"two roles for {r.path}" for r in candidates.where("evidence = 'conflict'").orderBy("path").collect()]
    return {"project_digest": digest, "roles": roles, "allow": allow, "risky": [f"{a}>{b}" for a, b in risky], "limits": limits, "features": features, "questions": questions, "toml": render(table, roles, allow, zones, limits, features)}


def render(table: str, roles: dict, allow: dict, zones: dict, limits: dict, features: dict) -> str:
    q = json.dumps
    lines = [f"[tool.{table}]", "schema_version = 5", "strict = true"]
    for r, include in roles.items():
        lines += ["", f"[tool.{table}.roles.{r}]", f"include = {q(include)}"]
    lines += ["", f"[tool.{table}.allow]", *(f"{a} = {q(b)}" for a, b in allow.items())]
    if zones:
        lines += ["", f"[tool.{table}.zones]", *(f"{a} = {q(b)}" for a, b in zones.items())]
    lines += ["", f"[tool.{table}.role_max_lines]", *(f"{a} = {b}" for a, b in limits.items())]
    lines += ["", f"[tool.{table}.assurance.features]", *(f"{a} = {q(b)}" for a, b in features.items())]
    return "\n".join(lines) + "\n"
