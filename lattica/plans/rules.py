"""The rules, each a plan from facts to findings, and for some a second plan to doubts.

A rule is judged for each module of its zones: a module that could not be read is indeterminate; one with a doubt is
indeterminate where the rule says that doubts come first, or if it has no finding; one with a finding fails; others pass.
Doubts come from names that matter to a rule and facts that may mean them (relevant()), and from plans of single rules.
A rule that has nothing to say about a module (by its role, mostly) is not applicable to it.
Findings carry module_id, path, line, column (from 0), symbol (what breaks the rule) and subject (what is broken).
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprints import canonical_json
from ..operators.names import glob_match, has_prefix
from ..sources.policy import RULES
from .facts import Catalog, attr, lines_of, mask

Plan = Callable[[Catalog], DataFrame | None]
FINDINGS: dict[str, Plan] = {}
DOUBTS: dict[str, list[tuple[Plan, bool]]] = {}
RELATIONSHIPS = ["sqlalchemy.orm.relationship", "sqlalchemy.orm.dynamic_loader"]
COLUMNS = ["module_id", "path", "line", "column", "symbol", "subject"]


def rule(name: str) -> Callable[[Plan], Plan]:
    def add(f: Plan) -> Plan:
        FINDINGS[name] = f
        return f

    return add


def doubt(*rules: str, first: bool = True) -> Callable[[Plan], Plan]:
    """first: a doubt outweighs findings. The plan gets the rule's name through the catalogue's policy."""

    def add(f: Plan) -> Plan:
        for name in rules:
            DOUBTS.setdefault(name, []).append((f, first))
        return f

    return add


def found(df: DataFrame, symbol: str | Column, subject: str | Column) -> DataFrame:
    text = lambda x: F.coalesce((F.col(x) if isinstance(x, str) else x).cast("string"), F.lit(""))
    return df.select("module_id", "path", "line", "column", text(symbol).alias("symbol"), text(subject).alias("subject"))


def union(*parts: DataFrame | None) -> DataFrame | None:
    some = [p for p in parts if p is not None]
    return reduce(DataFrame.union, some) if some else None


def under(column: str, prefixes: list[str]) -> Column:
    """The name is one of the prefixes or below; prefixes are configuration."""
    return reduce(lambda a, b: a | b, [has_prefix(F.col(column), F.lit(p)) for p in prefixes], F.lit(False))


def one_of(column: str, values: list[str]) -> Column:
    return F.col(column).isin(*values) if values else F.lit(False)


def whole(modules: DataFrame) -> DataFrame:
    return modules.withColumn("line", F.lit(0)).withColumn("column", F.lit(0))


def imports(c: Catalog) -> DataFrame:
    return c.placed(c.kind("import")).where("guard <> 'type_checking_only'")


def relevant(policy: dict) -> list[tuple]:
    """(rule_id, role or None, symbol, kind of fact, reason, first): names that matter to a rule, so that a fact which may,
    but need not, mean one of them makes the rule's verdict uncertain. What is written is never looked at."""
    b, tx = policy["boundaries"], policy["tx"]
    with_effect = lambda *effects: [s for s, (e, _) in policy["effects"].items() if set(e) & set(effects)]
    layers = [s for k in ("database_statement_calls", "transport_exception_calls", "dependency_injection_calls", "external_client_constructors", "raw_sql_calls") for s in b[k]]
    rows = [(r, None, s, kind, "uncertain_symbol", True) for r in ("ENTRY001", "SERVICE001", "QUERY001", "MODEL001") for s in layers for kind in ("call", "reference")]
    calls = {
        "ADAPTER001": b["adapter_forbidden_calls"],
        "DEPENDS001": b["dependency_injection_calls"],
        "WIRING001": b["external_client_constructors"] + b["adapter_implementation_symbols"],
        "CONFIG001": b["settings_constructors"],
        "SEC001": with_effect("security.environment", "security.secret", "security.token"),
        "LOG001": b["logged_external_calls"],
        "HTTP001": b["http_timeout_calls"],
        "TEST002": policy["code"]["raw_test_http_calls"],
    }
    rows += [(r, None, s, "call", "uncertain_symbol", True) for r, symbols in calls.items() for s in symbols]
    rows += [("BOUNDARY001", role, s, "call", "uncertain_symbol", True) for x in policy["import_boundaries"] for role in x["roles"] for s in x.get("forbidden_calls", [])]
    rows += [("SEC001", None, "os.environ", "reference", "uncertain_symbol", True)]
    rows += [(r, None, s, "call", "uncertain_symbol", False) for r in ("SESSION001", "SESSION002") for s in tx["session_providers"]]
    effects = {"TIME001": (True, ["time.now"]), "TX001": (True, ["tx.commit", "tx.rollback"]), "ASYNC001": (False, ["io.blocking"])}
    rows += [(r, None, s, "call", "uncertain_effect", first) for r, (first, of) in effects.items() for s in with_effect(*of)]
    rows += [("ORM001", None, s, "call", "uncertain_provider_fact", True) for s in RELATIONSHIPS]
    rows += [("SQL001", None, s, "call", "uncertain_provider_fact", True) for s in b["raw_sql_calls"]]
    return rows


def uncertain(c: Catalog, rows: list[tuple]) -> DataFrame:
    """rule_id, module_id, reason and first of the modules with an unresolved fact that may mean a relevant name: one join
    for all rules. The names are configuration."""
    names = c.spark.createDataFrame(rows, "rule_id string, of_role string, symbol string, kind string, reason string, first boolean")
    facts = c.facts.where(F.col("kind").isin("call", "reference") & (F.col("state") != "resolved")).select("module_id", "kind", F.explode("candidates").alias("symbol")).distinct()
    t = c.placed(facts.join(F.broadcast(names), ["symbol", "kind"]))
    return t.where("of_role IS NULL OR of_role = role").select("rule_id", "module_id", "reason", "first").distinct()


def unsure(c: Catalog, symbols: DataFrame) -> DataFrame:
    """Modules with a call that may, but need not, mean one of the symbols (column canonical)."""
    t = c.kind("call").where("state <> 'resolved'").select("module_id", F.explode("candidates").alias("canonical"))
    return t.join(symbols, "canonical", "left_semi").select("module_id", F.lit("uncertain_symbol").alias("reason"))


def unsure_import(prefixes_of: Callable[[Catalog], list[str]]) -> Plan:
    """Modules with an import that was not found and may lie below the prefixes: a relative one, since an absolute import
    names what it means."""

    def plan(c: Catalog):
        t = c.unresolved_imports.where((F.col("level") != "0") & under("symbol", prefixes_of(c)))
        return t.select("module_id", F.lit("uncertain_import").alias("reason"))

    return plan


def without_role(c: Catalog) -> DataFrame:
    return c.modules.where("role IS NULL").select("module_id", F.lit("missing_role").alias("reason"))


def keyword(name: str) -> Column:
    """A call's keyword argument, as an item; null if it isn't given."""
    return F.get(F.filter("items", lambda i: i["name"] == name), F.lit(0))


def inherits(c: Catalog, df: DataFrame, symbol: str, targets: list[str]) -> DataFrame:
    """Rows of df whose class inherits from one of the targets."""
    kin = c.ancestors.where(one_of("value", targets)).select(F.col("node").alias(symbol)).distinct()
    return df.join(kin, symbol, "left_semi")


# architecture


@rule("ARCH000")
def _(c: Catalog):
    return found(whole(c.modules.where("role IS NULL")), "module_id", F.lit("role"))


@rule("ARCH001")
def _(c: Catalog):
    allow = c.spark.createDataFrame([(a, b) for a, to in c.policy["allow"].items() for b in to] or [("", "")], "role string, target_role string")
    roles = c.modules.select(F.col("module_id").alias("target"), F.col("role").alias("target_role"))
    t = c.import_edges.where("NOT type_only").withColumnRenamed("importer", "module_id").join(roles, "target").where("target_role IS NOT NULL")
    t = c.placed(t).where("role IS NOT NULL").join(allow, ["role", "target_role"], "left_anti")
    one = t.groupBy("module_id", "target").agg(F.min_by(F.struct("path", "line", "column"), F.struct("line", "column", "n")).alias("f")).select("module_id", "target", "f.*")
    return found(one, "target", F.lit("import"))


@rule("ARCH002")
def _(c: Catalog):
    return found(whole(c.cycles.withColumnRenamed("component", "module_id").join(c.modules.select("module_id", F.col("path").alias("p")), "module_id").select("module_id", F.col("p").alias("path"), F.array_join("path", " > ").alias("cycle"))), "cycle", F.lit("cycle"))


@doubt("ARCH002", "EXC001")
def _(c: Catalog):
    """What depends on the whole project is uncertain everywhere if a module could not be read."""
    broken = c.modules.where("NOT complete").limit(1).select(F.lit(True).alias("_broken"))  # one row, if there are any
    return c.modules.join(F.broadcast(broken)).select("module_id", F.lit("incomplete_project").alias("reason"))


@doubt("BOUNDARY001")
def _(c: Catalog):
    return without_role(c) if c.policy["import_boundaries"] else without_role(c).limit(0)


doubt("BOUNDARY002")(unsure_import(lambda c: c.policy["boundaries"]["external_modules"]))
doubt("BOUNDARY003")(unsure_import(lambda c: c.policy["boundaries"]["contract_forbidden_modules"]))
doubt("ADAPTER001")(unsure_import(lambda c: c.policy["boundaries"]["adapter_forbidden_modules"]))


@rule("BOUNDARY001")
def _(c: Catalog):
    parts = []
    for b in c.policy["import_boundaries"]:
        if b.get("forbidden_imports"):
            parts.append(found(imports(c).where(one_of("role", b["roles"]) & under("symbol", b["forbidden_imports"])), "symbol", F.lit(b["name"])))
        if b.get("forbidden_calls"):
            parts.append(found(c.calls.where(one_of("role", b["roles"]) & (F.col("state") == "resolved") & glob_match(F.col("canonical"), b["forbidden_calls"])), "canonical", F.lit(b["name"])))
    both = union(*parts)
    return both.dropDuplicates(["module_id", "line", "column", "subject"]) if both is not None else None


def _forbidden_import(role_key: str, modules_key: str) -> Plan:
    def plan(c: Catalog):
        b = c.policy["boundaries"]
        return found(imports(c).where(one_of("role", b[role_key]) & under("symbol", b[modules_key])), "symbol", F.lit("import"))

    return plan


rule("BOUNDARY002")(_forbidden_import("service_roles", "external_modules"))
rule("BOUNDARY003")(_forbidden_import("contract_roles", "contract_forbidden_modules"))


@rule("ADAPTER001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    return union(_forbidden_import("adapter_roles", "adapter_forbidden_modules")(c), found(c.calls.where(one_of("role", b["adapter_roles"]) & one_of("canonical", b["adapter_forbidden_calls"])), "canonical", F.lit("call")))


@rule("ADAPTER002")
def _(c: Catalog):
    b = c.policy["boundaries"]
    t = c.functions.where(one_of("role", b["adapter_roles"]) & ~F.startswith("name", F.lit("_")) & ~F.contains("symbol", F.lit("._")))
    shown = F.array_union(F.transform("items", lambda i: i["symbol"]), F.array(attr("returns_symbol")))
    t = t.withColumn("_leak", F.get(F.filter(shown, lambda s: s.isNotNull() & reduce(lambda x, y: x | y, [has_prefix(s, F.lit(p)) for p in b["external_modules"]])), F.lit(0)))
    return found(t.where("_leak IS NOT NULL"), "_leak", "symbol")


@rule("ENTRY001")
def _(c: Catalog):
    b, allowed = c.policy["boundaries"], c.policy["entry_allowed_kinds"]
    may = lambda kind: one_of("role", [r for r, kinds in allowed.items() if kind in kinds])
    entry = one_of("role", b["entry_roles"])
    i, k = imports(c).where(entry), c.calls.where(entry)
    return union(
        found(i.where(under("symbol", b["database_modules"]) & ~may("database")), "symbol", F.lit("database")),
        found(i.where(under("symbol", b["external_modules"]) & ~may("external")), "symbol", F.lit("external")),
        found(k.where(one_of("canonical", b["database_statement_calls"]) & ~may("database")), "canonical", F.lit("database")),
        found(k.where(one_of("canonical", b["transport_exception_calls"]) & ~may("transport_exception")), "canonical", F.lit("transport_exception")),
    )


@rule("SERVICE001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    mine = one_of("role", b["service_roles"])
    return union(
        found(imports(c).where(mine & (under("symbol", b["transport_modules"]) | one_of("symbol", b["database_statement_calls"]))), "symbol", F.lit("import")),
        found(c.calls.where(mine & (one_of("canonical", b["database_statement_calls"]) | under("canonical", b["transport_modules"]))), "canonical", F.lit("call")),
    )


@rule("QUERY001")
def _(c: Catalog):
    b, tx = c.policy["boundaries"], c.policy["tx"]
    mine = one_of("role", b["query_roles"])
    writes = [s for s in b["database_statement_calls"] if s.rpartition(".")[2] in ("insert", "update", "delete", "create", "bulk_create", "bulk_update", "get_or_create", "update_or_create")]
    return union(
        found(imports(c).where(mine & (under("symbol", b["transport_modules"] + b["external_modules"]) | one_of("symbol", writes))), "symbol", F.lit("import")),
        found(c.calls.where(mine & (one_of("canonical", writes + tx["session_providers"]) | under("canonical", b["external_modules"]))), "canonical", F.lit("call")),
    )


@rule("MODEL001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    far = b["external_modules"] + b["transport_modules"]
    mine = one_of("role", b["model_roles"])
    return union(found(imports(c).where(mine & under("symbol", far)), "symbol", F.lit("import")), found(c.calls.where(mine & under("canonical", far)), "canonical", F.lit("call")))


@rule("DEPENDS001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    t = c.calls.where(one_of("canonical", b["dependency_injection_calls"]) & ~F.coalesce(one_of("role", b["entry_roles"]), F.lit(False)))
    up = c.kind("call").select("module_id", F.col("n").alias("parent"), F.col("symbol").alias("_up"), keyword("dependencies").isNotNull().alias("_as"))
    t = t.join(up, ["module_id", "parent"], "left")
    registers = one_of("role", b["dependency_registration_roles"]) & F.col("_up").isin("fastapi.FastAPI", "fastapi.APIRouter") & F.col("_as")
    return found(t.where(~F.coalesce(registers, F.lit(False))), "canonical", "owner")


def adapter_classes(c: Catalog) -> DataFrame:
    """canonical: the classes of adapters that implement something, by their names."""
    b = c.policy["boundaries"]
    return c.classes.where(one_of("role", b["adapter_roles"])).where(reduce(lambda x, y: x | y, [F.endswith("name", F.lit(s)) for s in b["adapter_implementation_suffixes"]], F.lit(False))).select(F.col("symbol").alias("canonical")).distinct()


@doubt("WIRING001")
def _(c: Catalog):
    return unsure(c, adapter_classes(c))


@rule("WIRING001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    ours = adapter_classes(c)
    fixed = c.spark.createDataFrame([(s,) for s in b["external_client_constructors"] + b["adapter_implementation_symbols"]] or [("",)], "canonical string")
    free = F.coalesce(one_of("role", b["bootstrap_roles"] + b["implementation_construction_roles"]), F.lit(False))
    scoped = F.coalesce(one_of("role", b["scoped_construction_roles"]), F.lit(False)) & (F.col("position") == "context_manager")
    return found(c.calls.where(~free & ~scoped).join(ours.union(fixed).distinct(), "canonical", "left_semi"), "canonical", "owner")


def settings_classes(c: Catalog) -> DataFrame:
    return c.bases.where(F.col("base").isin("pydantic_settings.BaseSettings", "pydantic.BaseSettings")).select(F.col("symbol").alias("canonical"))


@doubt("CONFIG001")
def _(c: Catalog):
    return unsure(c, settings_classes(c))


@rule("CONFIG001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    own = settings_classes(c)
    fixed = c.spark.createDataFrame([(s,) for s in b["settings_constructors"]] or [("",)], "canonical string")
    free = F.coalesce(one_of("role", b["configuration_roles"] + b["bootstrap_roles"]), F.lit(False))
    return found(c.calls.where(~free).join(own.union(fixed).distinct(), "canonical", "left_semi"), "canonical", "owner")


# effects


def has_effect(name: str) -> Column:
    return F.coalesce(F.col("effects").bitwiseAND(mask([name])) != 0, F.lit(False))


@rule("TIME001")
def _(c: Catalog):
    return found(c.calls.where(has_effect("time.now") & ~F.col("wrapped")).where(~one_of("owner", [s for s, (_, a) in c.policy["effects"].items() if a != "direct"])), "canonical", "owner")


@rule("ASYNC001")
def _(c: Catalog):
    running = c.functions.where(attr("is_async") == "true").select(F.col("symbol").alias("owner")).distinct()
    t = c.calls.join(running, "owner", "left_semi").join(c.summaries.select(F.col("node").alias("canonical"), "mask"), "canonical", "left").join(c.callback_effects, ["module_id", "n"], "left")
    bits = mask(["io.blocking"])
    blocks = (F.coalesce(F.col("effects"), F.lit(0)).bitwiseAND(bits) != 0) & ~F.coalesce("wrapped", F.lit(False)) | (F.coalesce(F.col("mask"), F.lit(0)).bitwiseAND(bits) != 0)
    handed = F.coalesce("callback_mask", F.lit(0)).bitwiseAND(bits) != 0
    return found(t.where(blocks | handed), "canonical", "owner")


@doubt("ASYNC001", first=False)
def _(c: Catalog):
    """A callback that may be run, of which it is not certain that it is, has a blocking effect."""
    running = c.functions.where(attr("is_async") == "true").select(F.col("symbol").alias("owner")).distinct()
    bits = mask(["io.blocking"])
    return c.calls.join(running, "owner", "left_semi").join(c.possible_callback_effects, ["module_id", "n"]).where(F.col("possible_mask").bitwiseAND(bits) != 0).select("module_id", F.lit("callback_effect").alias("reason"))


@rule("RUNTIME001")
def _(c: Catalog):
    running = c.functions.where(attr("is_async") == "true").select(F.col("symbol").alias("owner")).distinct()
    globs = c.policy["code"]["forbidden_runtime_calls"]
    return union(found(c.calls.where("canonical = 'asyncio.run'").join(running, "owner", "left_semi"), "canonical", "owner"), found(c.calls.where((F.col("state") == "resolved") & glob_match(F.col("canonical"), globs)), "canonical", "owner") if globs else None)


@rule("SEC001")
def _(c: Catalog):
    kinds = c.policy["security_roles"].items()
    calls = [found(c.calls.where(has_effect(e) & ~F.coalesce(one_of("role", roles), F.lit(False))), "canonical", F.lit(e)) for e, roles in kinds]
    env = c.placed(c.canonical(c.kind("reference").where("symbol = 'os.environ'"))).where(~F.coalesce(one_of("role", c.policy["security_roles"]["security.environment"]), F.lit(False)))
    held = c.calls.where(F.startswith("canonical", F.lit("os.environ."))).select("module_id", "line").distinct()
    return union(*calls, found(env.join(held, ["module_id", "line"], "left_anti"), "canonical", F.lit("security.environment")))


@rule("TX001")
def _(c: Catalog):
    return found(c.calls.where((has_effect("tx.commit") | has_effect("tx.rollback")) & F.col("role").isNotNull() & ~one_of("role", c.policy["tx"]["owner_roles"])), "canonical", "owner")


@doubt("TX001")
def _(c: Catalog):
    return c.calls.where((has_effect("tx.commit") | has_effect("tx.rollback")) & F.col("role").isNull()).select("module_id", F.lit("missing_role").alias("reason"))


@rule("TX002")
def _(c: Catalog):
    tx = c.policy["tx"]
    guards = tx["session_providers"] + tx["boundary_contexts"]
    atomic = c.functions.where(F.arrays_overlap(lines_of("decorators"), F.array(*map(F.lit, tx["boundary_decorators"] or [""])))).select(F.col("symbol").alias("owner"), F.lit(True).alias("_atomic")).distinct()
    t = c.calls.join(c.summaries.select(F.col("node").alias("canonical"), "mask"), "canonical", "left").join(atomic, "owner", "left")
    out = has_effect("external.call") | under("canonical", c.policy["boundaries"]["logged_external_calls"]) | (F.coalesce("mask", F.lit(0)).bitwiseAND(mask(["external.call"])) != 0)
    inside = F.coalesce("_atomic", F.lit(False)) | (F.arrays_overlap(lines_of("contexts"), F.array(*map(F.lit, guards))) if guards else F.lit(False))
    return found(t.where(out & inside), "canonical", "owner")


def write_counts(c: Catalog) -> DataFrame:
    """module_id, path, line, column, symbol, lower and upper of the functions of services that no boundary protects: how
    many writes to the database they make outside of transactions, for certain and at most."""
    from ..operators import graph

    writes = [s for s in c.policy["boundaries"]["database_statement_calls"] if s.rpartition(".")[2] in ("insert", "update", "delete", "create", "bulk_create", "bulk_update")]
    writes += [f"{s}.{m}" for s in c.policy["boundaries"]["session_type_symbols"] for m in ("add", "add_all", "delete", "merge")]
    tx = c.policy["tx"]
    safe = F.arrays_overlap(lines_of("contexts"), F.array(*map(F.lit, tx["boundary_contexts"] or [""])))
    calls = c.calls.where((F.col("scope") != "module") & ~safe).withColumn("call", F.concat_ws("#", "module_id", F.col("n").cast("string")))
    possible = calls.where("state <> 'resolved'")
    maybe_write = F.arrays_overlap("candidates", F.array(*map(F.lit, writes)))
    base = calls.where(one_of("canonical", writes)).select(F.col("owner").alias("node"), F.lit(1).alias("lower"), F.lit(1).alias("upper"))
    base = base.union(possible.where(maybe_write).select(F.col("owner"), F.lit(0), F.lit(1)))
    certain = calls.where("state = 'resolved'").select(F.col("owner").alias("src"), F.col("canonical").alias("dst"), F.lit(True).alias("certain"), "call")
    edges = certain.union(possible.select(F.col("owner"), F.explode("candidates"), F.lit(False), "call"))
    edges = edges.join(c.functions.select(F.col("symbol").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "certain", "call")
    atomic = c.functions.where(F.arrays_overlap(lines_of("decorators"), F.array(*map(F.lit, tx["boundary_decorators"] or [""])))).select(F.col("symbol").alias("node"))
    counts = graph.saturating_fixpoint(base, edges, cut=atomic).join(atomic, "node", "left_anti")
    return c.functions.where(one_of("role", c.policy["boundaries"]["service_roles"])).join(counts.withColumnRenamed("node", "symbol"), "symbol")


@rule("TX003")
def _(c: Catalog):
    return found(c.derived("write_counts", write_counts).where("lower >= 2"), "symbol", F.lit("writes"))


@doubt("TX003", first=False)
def _(c: Catalog):
    return c.derived("write_counts", write_counts).where("lower < 2 AND upper >= 2").select("module_id", F.lit("uncertain_transaction_write").alias("reason"))


def sessions_opened(c: Catalog) -> DataFrame:
    """Calls that open a session, but for those of the providers themselves."""
    providers = c.policy["tx"]["session_providers"]
    return c.calls.where(one_of("canonical", providers) & ~one_of("owner", providers))


@rule("SESSION001")
def _(c: Catalog):
    return found(sessions_opened(c).where(F.col("role").isNotNull() & ~one_of("role", c.policy["tx"]["owner_roles"])), "canonical", "owner")


@doubt("SESSION001", first=False)
def _(c: Catalog):
    return sessions_opened(c).where("role IS NULL").select("module_id", F.lit("missing_role").alias("reason"))


@rule("SESSION002")
def _(c: Catalog):
    from ..operators import graph

    providers = c.policy["tx"]["session_providers"]
    if not providers:
        return None
    base = c.calls.where(one_of("canonical", providers)).select(F.col("owner").alias("node"), F.lit(1).cast("long").alias("mask"))
    opens = graph.mask_fixpoint(base, c.call_graph).where("mask <> 0").select(F.col("node").alias("canonical"), F.lit(True).alias("_opens"))
    t = c.calls.where(F.arrays_overlap(lines_of("contexts"), F.array(*map(F.lit, providers)))).join(opens, "canonical", "left")
    return found(t.where(F.coalesce("_opens", F.lit(False)) | one_of("canonical", providers)), "canonical", "owner")


# Methods of a session that control its transaction.
TRANSACTION_CONTROL = ["begin", "begin_nested", "commit", "rollback"]


@rule("SESSION003")
def _(c: Catalog):
    """Functions of services that take a session. Managed ones may; participants and private helpers that only their own
    module calls may, as long as they neither open sessions nor control the transaction."""
    b, tx = c.policy["boundaries"], c.policy["tx"]
    approved = lambda kind: [a["symbol"] for a in c.policy["approvals"] if a["rule"] == "SESSION003" and a.get("kind") == kind]
    of = lambda symbols: one_of("symbol", symbols) | (F.arrays_overlap(lines_of("decorators"), F.array(*map(F.lit, symbols))) if symbols else F.lit(False))
    t = c.functions.where(one_of("role", b["service_roles"])).withColumn("_session", F.get(F.filter(F.transform("items", lambda i: i["symbol"]), lambda s: s.isin(*b["session_type_symbols"])), F.lit(0)))
    t = t.where("_session IS NOT NULL").withColumn("_participant", of(approved("participant")) | one_of("role", tx["participant_roles"]))
    t = t.where(F.col("_participant") | ~of(approved("managed")))
    called = c.calls.where("state = 'resolved'").select(F.col("canonical").alias("symbol"), F.col("module_id").alias("_by")).distinct()
    foreign = t.select("symbol", "module_id").join(called, "symbol").where("_by <> module_id").select("symbol", F.lit(True).alias("_foreign")).distinct()
    t = t.join(foreign, "symbol", "left")
    helper = F.startswith("name", F.lit("_")) & F.col("_foreign").isNull()
    own = c.calls.select(F.col("owner").alias("symbol"), "module_id", F.col("canonical").alias("_call"))
    method = F.substring_index("_call", ".", -1)
    controls = one_of("_call", tx["session_providers"]) | (method.isin(*TRANSACTION_CONTROL) & (F.col("_call") == F.concat_ws(".", "_session", method)))
    joined = t.where(F.col("_participant") | helper)
    unsafe = joined.join(own, ["symbol", "module_id"]).where(controls).groupBy("module_id", "path", "line", "column", "symbol").agg(F.min("_call").alias("_call"))
    return found(t.where(~F.col("_participant") & ~helper), "_session", "symbol").union(found(unsafe, "_call", "symbol"))


# persistence


@rule("ORM001")
def _(c: Catalog):
    """Relationships of models, whatever name they were imported under."""
    lazy = F.regexp_replace(F.coalesce(keyword("lazy")["literal"], F.lit("")), "['\"]", "")
    return found(c.calls.where(one_of("canonical", RELATIONSHIPS) & (F.col("scope") == "class") & ~lazy.isin("raise", "raise_on_sql")), "owner", F.lit("lazy"))


@rule("ORM002")
def _(c: Catalog):
    t = c.calls.where(F.col("canonical").isin("sqlalchemy.Enum", "sqlalchemy.types.Enum", "sqlalchemy.sql.sqltypes.Enum"))
    need = [F.when(keyword(k).isNull(), F.lit(k)) for k in ("name", "values_callable", "native_enum")]
    t = t.withColumn("_missing", F.concat_ws(",", *need))
    return found(t.where("_missing <> ''"), "canonical", "_missing")


@rule("DB001")
def _(c: Catalog):
    t = c.calls.where(F.col("canonical").isin("sqlalchemy.DateTime", "sqlalchemy.types.DateTime", "sqlalchemy.TIMESTAMP", "sqlalchemy.types.TIMESTAMP"))
    return found(t.where(F.coalesce(keyword("timezone")["literal"], F.lit("")) != "True"), "canonical", F.lit("timezone"))


@rule("SQL001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    raw = c.calls.where(one_of("canonical", b["raw_sql_calls"]))
    wraps = F.coalesce(one_of("role", b["raw_query_roles"]), F.lit(False)) & one_of("owner", b["raw_query_wrappers"])
    up = c.kind("call").select("module_id", F.col("n").alias("parent"), F.transform("items", lambda i: i["name"]).alias("_names"))
    schema = F.coalesce(one_of("role", b["schema_sql_roles"]), F.lit(False)) & F.coalesce(F.arrays_overlap("_names", F.array(*map(F.lit, b["schema_sql_argument_names"]))), F.lit(False))
    return found(raw.join(up, ["module_id", "parent"], "left").where(~wraps & ~schema), "canonical", "owner")


# external calls


@rule("HTTP001")
def _(c: Catalog):
    t = c.calls.where(one_of("canonical", c.policy["boundaries"]["http_timeout_calls"]))
    return found(t.where(keyword("timeout").isNull() & (attr("unpack") != "true")), "canonical", F.lit("timeout"))


@doubt("HTTP001", first=False)
def _(c: Catalog):
    t = c.calls.where(one_of("canonical", c.policy["boundaries"]["http_timeout_calls"]) & keyword("timeout").isNull() & (attr("unpack") == "true"))
    return t.select("module_id", F.lit("dynamic_keywords").alias("reason"))


@rule("LOG001")
def _(c: Catalog):
    b = c.policy["boundaries"]
    wrapped = one_of("owner", b["external_call_wrappers"]) | (F.arrays_overlap(lines_of("contexts"), F.array(*map(F.lit, b["external_call_wrappers"]))) if b["external_call_wrappers"] else F.lit(False))
    return found(c.calls.where((has_effect("external.call") | under("canonical", b["logged_external_calls"])) & ~wrapped), "canonical", "owner")


@rule("CAT001")
def _(c: Catalog):
    return found(c.calls.where((F.col("state") == "resolved") & F.col("effects").isNull() & under("canonical", c.policy["risky_prefixes"])), "canonical", "owner")


@doubt("CAT001", first=False)
def _(c: Catalog):
    maybe = c.kind("call").where("state <> 'resolved'").select("module_id", F.explode("candidates").alias("_s"))
    risky = reduce(lambda x, y: x | y, [F.startswith("_s", F.lit(p)) for p in c.policy["risky_prefixes"]], F.lit(False))
    return maybe.where(risky).select("module_id", F.lit("uncertain_symbol").alias("reason"))


# conventions


@rule("IMPORT001")
def _(c: Catalog):
    from ..operators import graph

    local = c.placed(c.kind("import")).where(F.col("scope").isin("function", "lambda")).where((attr("intent") == "normal") & (F.col("guard") != "type_checking_only"))
    edges = c.import_edges.where("eager").select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()
    pairs = c.import_edges.where("scope <> 'module'").select("importer", "n", "target").distinct()
    # the target reaches the importer over eager imports: only then does a local import break a cycle
    starts = pairs.select(F.col("target").alias("node"), F.col("target").alias("value")).distinct()
    reach = graph.set_fixpoint(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    breaks = pairs.join(reach.select(F.col("node").alias("importer"), F.col("value").alias("target")), ["importer", "target"], "left_semi").select(F.col("importer").alias("module_id"), "n")
    relative = c.placed(c.kind("import")).join(c.modules.select("module_id", "is_package"), "module_id").where((attr("level") != "0") & ~F.col("is_package") & ~F.contains("module_id", F.lit(".")))
    return union(found(local.join(breaks, ["module_id", "n"], "left_anti"), F.lit("local_import"), "symbol"), found(relative, F.lit("relative_import"), "symbol")).dropDuplicates(["module_id", "line", "column"])


@rule("IMPORT002")
def _(c: Catalog):
    return found(c.calls.where(F.col("canonical").isin("builtins.__import__", "importlib.import_module")), "canonical", "owner")


@rule("SIZE001")
def _(c: Catalog):
    limit = F.coalesce(*[F.when(F.col("role") == r, F.lit(n)) for r, n in c.policy["role_max_lines"].items()], F.lit(c.policy["max_lines"]))
    return found(whole(c.modules.where(F.col("role").isNotNull() & (F.col("line_count") > limit))), "line_count", limit)


@doubt("SIZE001")
def _(c: Catalog):
    return without_role(c)


# shapes


def models(c: Catalog) -> DataFrame:
    """Classes that inherit from Pydantic's base."""
    return inherits(c, c.classes, "symbol", ["pydantic.BaseModel", "pydantic.main.BaseModel"])


@rule("DTO001")
def _(c: Catalog):
    dto = c.classes.where(one_of("role", c.policy["code"]["dto_roles"]))
    decorated = c.kind("decorator").where(F.col("symbol").isin("dataclasses.dataclass", "dataclass")).select(attr("decorated").alias("symbol"), (F.coalesce(keyword("frozen")["literal"], F.lit("")) == "True").alias("_frozen"))
    loose = dto.join(decorated.where("NOT _frozen").select("symbol").distinct(), "symbol", "left_semi")
    frozen = c.fields.where("name = 'model_config'").where(F.coalesce(keyword("frozen")["literal"], F.lit("")) == "True").select(F.col("owner").alias("symbol")).distinct()
    kept = frozen.union(c.ancestors.join(frozen.withColumnRenamed("symbol", "value"), "value", "left_semi").select(F.col("node").alias("symbol"))).distinct()
    plain = models(c).where(one_of("role", c.policy["code"]["dto_roles"])).join(kept, "symbol", "left_anti")
    mutable = c.fields.where(one_of("role", c.policy["code"]["dto_roles"]) & (F.col("scope") == "class") & attr("annotation").rlike(r"^(typing\.)?(list|dict|set|List|Dict|Set|bytearray)\b"))
    return union(found(loose, "symbol", F.lit("frozen")), found(plain, "symbol", F.lit("frozen")), found(mutable, "symbol", attr("annotation")))


@rule("DTO002")
def _(c: Catalog):
    ends = reduce(lambda a, b: a | b, [F.endswith("name", F.lit(s)) for s in c.policy["code"]["dto_name_suffixes"]])
    return found(c.classes.where(one_of("role", c.policy["code"]["dto_roles"]) & ~ends), "symbol", F.lit("suffix"))


@rule("SNAPSHOT001")
def _(c: Catalog):
    t = models(c).where(F.contains("name", F.lit("Snapshot")))
    return found(t.where(~F.coalesce(one_of("role", c.policy["code"]["snapshot_roles"]), F.lit(False)) | ~F.col("name").rlike(r"SnapshotV[1-9][0-9]*\z")), "symbol", F.lit("snapshot"))


@rule("SCHEMA001")
def _(c: Catalog):
    wanted = c.policy["code"]["request_config_symbols"] + c.policy["code"]["response_config_symbols"]
    if not wanted:
        return None
    configured = c.fields.where((F.col("name") == "model_config") & attr("value_symbol").isin(*wanted)).select(F.col("owner").alias("symbol"))
    return found(models(c).where(one_of("role", c.policy["code"]["schema_roles"])).join(configured, "symbol", "left_anti"), "symbol", F.lit("model_config"))


@rule("SCHEMA002")
def _(c: Catalog):
    t = c.classes.where(one_of("role", c.policy["code"]["schema_roles"])).join(c.bases.where(F.startswith("base", F.lit("app."))), "symbol")
    return found(t, "base", "symbol")


@rule("SCHEMA003")
def _(c: Catalog):
    name = c.policy["code"]["response_mapper_name"]
    responses = models(c).where(one_of("role", c.policy["code"]["schema_roles"]) & F.endswith("name", F.lit("Response")))
    mapper = c.functions.where((F.col("name") == name) & F.array_contains(lines_of("decorators"), "builtins.classmethod") & (F.size("items") >= 2)).select(F.col("owner").alias("symbol"))
    built = c.calls.where(one_of("role", c.policy["code"]["router_roles"])).join(responses.select(F.col("symbol").alias("canonical")), "canonical", "left_semi")
    return union(found(responses.join(mapper, "symbol", "left_anti"), "symbol", F.lit(name)), found(built, "canonical", "owner"))


ROUTES = ("get", "post", "put", "patch", "delete", "head", "options", "api_route")


def endpoints(c: Catalog) -> DataFrame:
    """Route decorators with their function's docstring flag."""
    d = c.placed(c.kind("decorator")).where(F.col("symbol").isin(*(f"fastapi.{o}.{m}" for o in ("FastAPI", "APIRouter") for m in ROUTES)) | F.substring_index("name", ".", -1).isin(*ROUTES) & F.split_part("name", F.lit("."), F.lit(1)).isin("router", "app"))
    return d.join(c.kind("function").select(F.col("symbol").alias("_f"), attr("docstring").alias("_doc")), attr("decorated") == F.col("_f"))


@rule("API001")
def _(c: Catalog):
    need = F.concat_ws(",", F.when(F.col("_doc") != "true", F.lit("docstring")), *[F.when(keyword(k).isNull() & (attr("unpack") != "true"), F.lit(k)) for k in ("responses", "response_model")])
    return found(endpoints(c).withColumn("_need", need).where("_need <> ''"), "_f", "_need")


@doubt("API001", first=False)
def _(c: Catalog):
    return endpoints(c).where(attr("unpack") == "true").select("module_id", F.lit("unresolved_mapping").alias("reason"))


@rule("API002")
def _(c: Catalog):
    t = c.fields.where((F.col("scope") == "class") & (attr("annotated") == "true") & one_of("role", c.policy["code"]["schema_roles"]))
    t = t.join(models(c).select(F.col("symbol").alias("owner")), "owner", "left_semi")
    need = F.concat_ws(",", *[F.when(keyword(k).isNull(), F.lit(k)) for k in ("description", "examples")])
    return found(t.withColumn("_need", need).where("_need <> '' AND name <> 'model_config'"), "symbol", "_need")


@doubt("API002", first=False)
def _(c: Catalog):
    """A field of a model whose declaring call may, but need not, be Pydantic's."""
    names = ["pydantic.Field", "pydantic.fields.Field"]
    calls = c.kind("call").where((F.col("state") != "resolved") & (F.col("scope") == "class") & F.arrays_overlap("candidates", F.array(*map(F.lit, names)))).select("module_id", "owner", "line")
    fields = c.fields.where(one_of("role", c.policy["code"]["schema_roles"]) & (attr("value_kind") == "Call")).select("module_id", "owner", "line")
    own = models(c).select(F.col("symbol").alias("owner"))
    return fields.join(calls, ["module_id", "owner", "line"]).join(own, "owner", "left_semi").select("module_id", F.lit("uncertain_field_declaration").alias("reason"))


@rule("API003")
def _(c: Catalog):
    made = c.calls.where("canonical = 'fastapi.APIRouter'").where(keyword("tags").isNull())
    params = c.calls.where(F.col("canonical").isin(*(f"fastapi.{x}" for x in ("Query", "Path", "Header", "Cookie", "Body", "Form", "File")))).where(keyword("description").isNull())
    tagged = c.calls.where(F.substring_index("canonical", ".", -1) == "include_router").where(keyword("tags").isNotNull()).select(F.explode("items").alias("i")).select(F.split_part("i.symbol", F.lit(".router"), F.lit(1)).alias("module_id")).distinct()
    return union(found(made.join(tagged, "module_id", "left_anti"), "canonical", F.lit("tags")), found(params, "canonical", F.lit("description")))


@rule("ENUM001")
def _(c: Catalog):
    kin = inherits(c, c.classes, "symbol", ["enum.Enum", "enum.StrEnum", "enum.IntEnum"])
    shared = c.policy["code"]["shared_enum_modules"]
    members = c.fields.where("scope = 'class'").join(kin.select(F.col("symbol").alias("owner")), "owner", "left_semi").where(~F.startswith("name", F.lit("_")))
    return union(
        found(kin.where(~F.endswith("name", F.lit("Enum"))), "symbol", F.lit("suffix")),
        found(kin.where(~under("module_id", shared)), "symbol", F.lit("location")) if shared else None,
        found(members.where(~F.col("name").rlike(r"^[A-Z][A-Z0-9_]*\z")), "symbol", F.lit("member_name")),
    )


@rule("EXC001")
def _(c: Catalog):
    code = c.policy["code"]
    if not code["exception_base_symbols"]:
        return None
    kin = inherits(c, c.classes, "symbol", code["exception_base_symbols"])
    given = c.fields.where(one_of("name", code["exception_code_field_names"])).select(F.col("owner").alias("symbol"), F.coalesce(F.nullif(attr("value_symbol"), F.lit("")), attr("value")).alias("code"))
    coded = kin.join(given, "symbol", "left")
    twice = given.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    listed = c.fields.where(one_of("owner", code["error_code_enum_symbols"])).select("module_id", "path", "line", "column", F.col("symbol").alias("code"))
    unused = listed.join(given, "code", "left_anti")
    return union(found(coded.where("code IS NULL"), "symbol", F.lit("missing_code")), found(coded.join(twice, "code", "left_semi"), "symbol", "code"), found(unused, "code", F.lit("unused_code")))


@doubt("EXC001")
def _(c: Catalog):
    """A constructor of an exception hands its code to a call that may be another exception's constructor."""
    code = c.policy["code"]
    if not code["exception_base_symbols"]:
        return without_role(c).limit(0)
    made = inherits(c, c.classes, "symbol", code["exception_base_symbols"]).select(F.concat_ws(".", "symbol", F.lit("__init__")).alias("made")).distinct()
    named = F.exists("items", lambda i: i["name"].isin(*code["exception_code_argument_names"]))
    t = c.kind("call").where((F.col("state") != "resolved") & named).select("module_id", F.col("owner").alias("made"), "candidates")
    t = t.join(made, "made", "left_semi").select("module_id", F.explode("candidates").alias("made")).join(made, "made", "left_semi")
    return t.select("module_id", F.lit("uncertain_symbol").alias("reason"))


@rule("TEST001")
def _(c: Catalog):
    roots = c.policy["code"]["test_root_paths"]
    ok = reduce(lambda a, b: a | b, [F.col("path") == f"{r}/conftest.py" for r in roots], F.lit(False))
    return found(whole(c.modules.where(F.col("path").rlike(r"(^|/)conftest\.py\z") & ~ok)), "path", F.lit("layout"))


@rule("TEST002")
def _(c: Catalog):
    from ..operators import graph

    raw = c.policy["code"]["raw_test_http_calls"]
    if not raw:
        return None
    fixtures = c.kind("decorator").where(F.col("symbol").isin("pytest.fixture", "pytest_asyncio.fixture")).select(attr("decorated").alias("symbol"))
    fixed = c.functions.join(fixtures, "symbol", "left_semi")
    approved = fixed.where(one_of("symbol", c.policy["code"]["test_http_fixture_symbols"]) | F.coalesce(one_of("role", c.policy["code"]["test_http_fixture_roles"]), F.lit(False)))
    needs = fixed.select(F.col("name").alias("src"), F.explode(F.transform("items", lambda i: i["name"])).alias("dst"))
    known = graph.set_fixpoint(approved.select(F.col("name").alias("node"), F.lit("ok").alias("value")), needs).select(F.col("node").alias("fixture"))
    takes = c.functions.select(F.col("symbol").alias("owner"), F.explode(F.transform("items", lambda i: i["name"])).alias("fixture")).join(known, "fixture", "left_semi").select("owner").distinct()
    return found(c.calls.where(one_of("canonical", raw)).join(takes, "owner", "left_anti"), "canonical", "owner")


@rule("IGNORE001")
def _(c: Catalog):
    return None  # comes from the suppression step, which knows what was used


def applies(policy: dict) -> dict[str, Column]:
    """Conditions on a module (role and path) without which a rule says nothing about it."""
    b, code = policy["boundaries"], policy["code"]
    in_roles = lambda roles: F.coalesce(one_of("role", roles), F.lit(False))
    found_ = {"ARCH001": F.col("role").isNotNull(), "BOUNDARY001": in_roles(sorted({r for x in policy["import_boundaries"] for r in x["roles"]})) | (F.col("role").isNull() & F.lit(bool(policy["import_boundaries"]))), "TEST001": F.col("path").rlike(r"(^|/)conftest\.py\z"), "IGNORE001": F.lit(False)}
    sets = {"BOUNDARY002": "service_roles", "BOUNDARY003": "contract_roles", "ADAPTER001": "adapter_roles", "ADAPTER002": "adapter_roles", "ENTRY001": "entry_roles", "SERVICE001": "service_roles", "QUERY001": "query_roles", "MODEL001": "model_roles", "SESSION003": "service_roles"}
    found_ |= {r: in_roles(b[k]) for r, k in sets.items()}
    found_ |= {r: in_roles(code[k]) for r, k in {"DTO001": "dto_roles", "DTO002": "dto_roles", "SCHEMA001": "schema_roles", "SCHEMA002": "schema_roles", "API002": "schema_roles"}.items()}
    found_["ORM001"] = in_roles(b["model_roles"])
    return found_ | {r: F.col("role").isNotNull() for r in ("WIRING001", "CONFIG001", "DEPENDS001", "SEC001")}


def evaluate(c: Catalog, rules: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluations, findings). evaluations: rule_id, module_id, path, zone, level, verdict, reason, one for each rule and
    module of the rule's zones. findings: those of failed evaluations, with level and fingerprint."""
    chosen = [r for r in (RULES if rules is None else rules) if c.policy["levels"][r] != "off"]
    tag = lambda df, name: df.withColumn("rule_id", F.lit(name))
    raw, unsure_ = [], []
    for r in chosen:
        try:  # a rule that fails takes no other with it
            own = FINDINGS[r](c)
            doubts = [tag(plan(c), r).select("rule_id", "module_id", "reason", F.lit(first).alias("first")) for plan, first in DOUBTS.get(r, [])]
        except Exception as e:
            c.failures.append((r, str(e).splitlines()[0] if str(e) else type(e).__name__))
            unsure_.append(tag(c.modules, r).select("rule_id", "module_id", F.lit("RULE_FAILURE").alias("reason"), F.lit(True).alias("first")))
            continue
        raw += [tag(own, r).select("rule_id", *COLUMNS)] if own is not None else []
        unsure_ += doubts
    failed = {r for r, _ in c.failures}
    if names := [x for x in relevant(c.policy) if x[0] in chosen and x[0] not in failed]:
        unsure_.append(uncertain(c, names))
    scope = c.spark.createDataFrame([(r, z, c.policy["levels"][r]) for r in chosen for z in c.policy["rule_zones"][r]], "rule_id string, zone string, level string")
    targets = c.modules.select("module_id", "path", "role", "zone", "complete").join(F.broadcast(scope), "zone")  # rules and zones are configuration
    conditions = [(F.col("rule_id") == r) & ~condition for r, condition in applies(c.policy).items() if r in chosen]
    targets = targets.withColumn("silent", reduce(lambda a, b: a | b, conditions, F.lit(False)))
    empty = c.spark.createDataFrame([], "rule_id string, module_id string, path string, line int, column int, symbol string, subject string")
    hits = reduce(DataFrame.unionByName, raw, empty)
    doubts = reduce(DataFrame.union, unsure_, c.spark.createDataFrame([], "rule_id string, module_id string, reason string, first boolean"))
    per_hit = hits.groupBy("rule_id", "module_id").agg(F.count("*").alias("hits"))
    per_doubt = doubts.groupBy("rule_id", "module_id").agg(F.min(F.struct(~F.col("first"), "reason"))["reason"].alias("doubt"), F.bool_or("first").alias("first"))
    t = targets.join(per_hit, ["rule_id", "module_id"], "left").join(per_doubt, ["rule_id", "module_id"], "left")
    verdict = F.when(~F.col("complete"), "indeterminate").when(F.col("silent"), "not_applicable").when(F.col("first"), "indeterminate").when(F.col("hits") > 0, "fail").when(F.col("doubt").isNotNull(), "indeterminate").otherwise("pass")
    reason = F.when(~F.col("complete"), "incomplete_module").when(verdict == "indeterminate", F.col("doubt"))
    evaluations = t.select("rule_id", "module_id", "path", "zone", "level", verdict.alias("verdict"), reason.alias("reason"))
    evidence = F.sha2(canonical_json(F.struct("rule_id", "module_id", "symbol", "subject")).cast("binary"), 256)
    findings = hits.join(evaluations.where("verdict = 'fail'").select("rule_id", "module_id", "zone", "level"), ["rule_id", "module_id"]).withColumn("fingerprint", evidence)
    return evaluations, findings
