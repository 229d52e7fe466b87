"""The tables that rules read: facts of the sources and what is derived from them."""

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joins, names
from ..sources.extract import extract
from ..storage import written

EFFECTS = ("time.now", "tx.commit", "tx.rollback", "io.blocking", "external.call", "security.environment", "security.secret", "security.token")


def attr(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", name), F.lit(""))


def lines_of(name: str) -> Column:
    """An attribute that holds a list, one member a line."""
    return F.filter(F.split(attr(name), "\n"), lambda x: x != "")


def mask(effects: list[str]) -> int:
    return sum(1 << EFFECTS.index(e) for e in effects)


class Catalog:
    """Named tables over sources (path, module_id, is_package, content, line_count, status) and a policy. Facts are
    extracted once and written, unless they are given; every table after that is a plan over them."""

    def __init__(self, sources: DataFrame, policy: dict, facts: DataFrame | None = None):
        self.policy, self.all_sources = policy, sources
        self.sources = sources.where("status = 'analyzed'")
        self.spark = sources.sparkSession
        self.failures: list[tuple[str, str]] = []
        self._derived: dict[str, DataFrame] = {}
        self.facts = facts if facts is not None else written(extract(self.sources))

    def kind(self, name: str) -> DataFrame:
        return self.facts.where(F.col("kind") == name)

    @cached_property
    def modules(self) -> DataFrame:
        """path, module_id, line_count, role, zone, complete."""
        failed = self.kind("failure").select("module_id", F.lit(False).alias("_ok")).distinct()
        kept = self.sources.select("path", "module_id", "is_package", "line_count", "content_hash")
        known = names.classify(kept, self.policy["roles"], self.policy["zones"], default_zone=self.policy["default_zone"])
        return written(known.join(failed, "module_id", "left").withColumn("complete", F.coalesce("_ok", F.lit(True))).drop("_ok"))

    def derived(self, name: str, make: Callable[["Catalog"], DataFrame]) -> DataFrame:
        """make()'s table, written once for all that read it."""
        if name not in self._derived:
            self._derived[name] = written(make(self))
        return self._derived[name]

    @property
    def issues(self) -> DataFrame:
        """Modules that could not be read, and rules that failed."""
        failed = self.spark.createDataFrame([("RULE_FAILURE", ".", f"{r}: {text}") for r, text in self.failures], "code string, path string, message string")
        return self.kind("failure").select(F.col("name").alias("code"), "path", attr("message").alias("message")).union(failed)

    @cached_property
    def import_edges(self) -> DataFrame:
        """importer, target, type_only, deferred, eager and the place of every import of a module of the project."""
        imports = self.kind("import").select("module_id", "path", "n", "line", "column", "guard", "phase", "symbol", "scope", "owner", attr("intent").alias("intent"))
        joined = names.prefix_join(imports, "symbol", self.modules.select(F.col("module_id").alias("target")), "target")
        t = joined.where("target <> module_id OR symbol = module_id").withColumnRenamed("module_id", "importer")
        type_only = F.col("guard") == "type_checking_only"
        return written(t.select("importer", "target", "path", "n", "line", "column", "scope", "owner", "intent", type_only.alias("type_only"), (F.col("phase") == "deferred").alias("deferred"), (~type_only & (F.col("phase") == "module_init")).alias("eager")))

    @cached_property
    def unresolved_imports(self) -> DataFrame:
        """Imports that name the project (a root of it, or relative) but none of its modules."""
        roots = self.modules.select(F.split_part("module_id", F.lit("."), F.lit(1)).alias("root")).distinct()
        t = self.kind("import").select("module_id", "path", "n", "line", "column", "symbol", attr("level").alias("level")).withColumn("root", F.split_part("symbol", F.lit("."), F.lit(1)))
        t = t.join(self.import_edges.select(F.col("importer").alias("module_id"), "n"), ["module_id", "n"], "left_anti")
        return t.join(roots.withColumn("ours", F.lit(True)), "root", "left").where("ours OR level <> '0'").drop("ours", "root")

    @cached_property
    def aliases(self) -> DataFrame:
        """alias, target: names that modules hand on by unconditional imports, followed to where they are defined."""
        t = self.kind("import").where("scope = 'module' AND guard = 'unconditional'").where((attr("is_from") == "true") & (attr("intent") == "normal") & (attr("imported") != "*"))
        local = F.when(attr("alias") != "", attr("alias")).otherwise(attr("imported"))
        last = t.groupBy("module_id", local.alias("local")).agg(F.max_by("symbol", F.struct("line", "column", "n")).alias("target"))
        own = self.modules.select(F.col("module_id"))
        return written(graph.alias_chase(last.join(own, "module_id").select(F.concat_ws(".", "module_id", "local").alias("alias"), "target").where("alias <> target")))

    def canonical(self, df: DataFrame, column: str = "symbol") -> DataFrame:
        return names.canonicalize(df, column, self.aliases)

    @cached_property
    def calls(self) -> DataFrame:
        """Calls with canonical symbol, the classification of their module, and effect bits of what they call."""
        t = self.canonical(self.kind("call"))
        return written(self.placed(t).join(self.catalog, F.col("canonical") == F.col("effect_symbol"), "left"))

    @cached_property
    def catalog(self) -> DataFrame:
        """effect_symbol, effects (bits), wrapped: the effect catalogue as a table of configuration."""
        rows = [(s, mask(e), access != "direct") for s, (e, access) in self.policy["effects"].items()]
        return F.broadcast(self.spark.createDataFrame(rows, "effect_symbol string, effects long, wrapped boolean"))

    def placed(self, df: DataFrame) -> DataFrame:
        """df with role, zone and completeness of its modules."""
        return df.join(self.modules.select("module_id", "role", "zone", "complete"), "module_id")

    @cached_property
    def functions(self) -> DataFrame:
        return self.placed(self.kind("function"))

    @cached_property
    def classes(self) -> DataFrame:
        return self.placed(self.kind("class"))

    @cached_property
    def fields(self) -> DataFrame:
        return self.placed(self.kind("field"))

    @cached_property
    def bases(self) -> DataFrame:
        """symbol, base: canonical bases of each class."""
        t = self.kind("class").select("symbol", F.explode("items").alias("i")).where("i.position IS NOT NULL AND i.symbol IS NOT NULL").select("symbol", F.col("i.symbol").alias("b"))
        return written(self.canonical(t, "b").select("symbol", F.col("canonical").alias("base")))

    @cached_property
    def ancestors(self) -> DataFrame:
        """node, value: all classes that a class inherits from, directly or not."""
        own = self.bases.select(F.col("symbol").alias("node"), F.col("base").alias("value"))
        return written(graph.set_fixpoint(own, self.bases.select(F.col("symbol").alias("src"), F.col("base").alias("dst"))))

    @cached_property
    def call_graph(self) -> DataFrame:
        """src, dst: functions and those functions or methods of the project that they call."""
        known = self.kind("function").select(F.col("symbol").alias("dst")).distinct()
        return written(self.calls.where("scope <> 'module'").select(F.col("owner").alias("src"), F.col("canonical").alias("dst")).join(known, "dst", "left_semi").select("src", "dst"))

    @cached_property
    def callbacks(self) -> DataFrame:
        """node: parameters (function.parameter) that a plain function calls, itself or through functions that it hands them
        on to; certain: unconditionally and outside of contexts all the way."""
        plain = self.kind("function").where("scope = 'module'").where((attr("is_async") != "true") & (attr("decorators") == ""))
        own = plain.select(F.col("symbol").alias("owner"), F.explode("items").alias("i")).select("owner", F.concat_ws(".", "owner", "i.name").alias("node"))
        named = self.kind("binding").where(attr("binding") != "parameter").select(F.col("symbol").alias("node")).distinct()
        own = own.join(named, "node", "left_anti")  # a name that is bound again is no longer the parameter
        sure = (F.col("guard") == "unconditional") & (attr("contexts") == "")
        called = self.kind("call").where("state = 'resolved'").select("owner", F.col("symbol").alias("node"), sure.alias("sure")).join(own, ["owner", "node"], "left_semi")
        bound = self.bound_arguments.join(own.select(F.col("node").alias("value"), F.col("owner").alias("caller")), ["value", "caller"])
        out = None
        for certain in (False, True):
            base = called.where("sure") if certain else called
            edges = bound.where("sure") if certain else bound
            known = graph.set_fixpoint(base.select("node", F.lit(1).alias("value")), edges.select(F.col("value").alias("src"), F.concat_ws(".", "function", "parameter").alias("dst"))).select("node", F.lit(certain).alias("certain"))
            out = known if out is None else out.union(known)
        return written(out.groupBy("node").agg(F.bool_or("certain").alias("certain")))

    @cached_property
    def bound_arguments(self) -> DataFrame:
        """module_id, n, caller, function, parameter, value (a symbol) and sure of the arguments of calls of the project's
        functions."""
        f = self.kind("function").where("scope = 'module'")
        params = f.select(F.col("symbol").alias("function"), F.posexplode("items").alias("position", "i")).select("function", "i.name", "position", F.col("i.kind").alias("kind"), (F.col("i.literal").isNull() & ~F.col("i.kind").isin("var_positional", "var_keyword")).alias("required"))
        t = self.calls.where("state = 'resolved'").where(attr("unpack") != "true").join(f.select(F.col("symbol").alias("canonical")).distinct(), "canonical", "left_semi")
        call_id = F.concat_ws("#", "module_id", F.col("n").cast("string"))
        calls = t.select(call_id.alias("call_id"), F.col("canonical").alias("function"), F.transform("items", lambda i: F.struct(i["name"].alias("name"), i["position"].alias("position"), i["symbol"].alias("value"))).alias("args"))
        where = t.select(call_id.alias("call_id"), "module_id", "n", F.col("owner").alias("caller"), F.col("canonical").alias("function"), ((F.col("guard") == "unconditional") & (attr("contexts") == "")).alias("sure"))
        return written(joins.bind_arguments(calls, params).where("value IS NOT NULL").join(where, "call_id").drop("call_id"))

    @cached_property
    def handed_effects(self) -> DataFrame:
        """module_id, n, effects, certain: effects of what a call hands to parameters that are called, or may be."""
        given = self.bound_arguments.withColumn("node", F.concat_ws(".", "function", "parameter")).join(self.callbacks, "node")
        t = self.canonical(given, "value").join(self.catalog.where("NOT wrapped"), F.col("canonical") == F.col("effect_symbol"))
        return written(t.select("module_id", "n", "effects", "certain"))

    @cached_property
    def callback_effects(self) -> DataFrame:
        """module_id, n, callback_mask: effects of what a call hands to parameters that are certainly called."""
        return self.handed_effects.where("certain").groupBy("module_id", "n").agg(F.bit_or("effects").alias("callback_mask"))

    @cached_property
    def possible_callback_effects(self) -> DataFrame:
        """module_id, n, possible_mask: effects of what a call hands to parameters that may be called."""
        return self.handed_effects.where("NOT certain").groupBy("module_id", "n").agg(F.bit_or("effects").alias("possible_mask"))

    @cached_property
    def summaries(self) -> DataFrame:
        """node, mask: effects that a function reaches by direct access, through any chain of calls."""
        base = self.calls.where("effects > 0 AND NOT wrapped AND scope <> 'module'").select(F.col("owner").alias("node"), F.col("effects").alias("mask"))
        handed = self.calls.where("scope <> 'module'").join(self.callback_effects, ["module_id", "n"]).select(F.col("owner").alias("node"), F.col("callback_mask").alias("mask"))
        base = base.union(handed)
        return written(graph.mask_fixpoint(base, self.call_graph))

    @cached_property
    def cycles(self) -> DataFrame:
        """component, path: eager import cycles."""
        edges = self.import_edges.where("eager").select(F.col("importer").alias("src"), F.col("target").alias("dst")).distinct()
        return written(graph.cycle_witness(edges, graph.scc(edges)))
