"""Views of frameworks over the facts: each is a plan on resolved symbols, never on source text.

Every view has module_id, path, line, column, symbol (what it is) and confidence (how surely it is that), and some more
columns of its own.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, joins
from .facts import Catalog, attr
from .rules import ROUTES, inherits, keyword, one_of, under

VIEWS: dict[str, Callable[[Catalog], DataFrame]] = {}
BASE = ["module_id", "path", "line", "column"]


def view(name: str):
    def add(f):
        VIEWS[name] = f
        return f

    return add


def rows(df: DataFrame, symbol, *more) -> DataFrame:
    return df.select(*BASE, (F.col(symbol) if isinstance(symbol, str) else symbol).alias("symbol"), F.col("state").alias("confidence"), *more)


def calls_of(c: Catalog, symbols: list[str]) -> DataFrame:
    """Calls that are, or may be, one of the symbols."""
    return c.calls.where(one_of("canonical", symbols) | F.arrays_overlap("candidates", F.array(*map(F.lit, symbols))))


def bound_to(c: Catalog, symbols: list[str]) -> DataFrame:
    """symbol: names whose value is a call of one of the symbols, however the call is written."""
    t = c.fields.where(attr("value_kind") == "Call").select("symbol", attr("value_symbol").alias("called"))
    return c.canonical(t, "called").where(one_of("canonical", symbols)).select("symbol").distinct()


def last_part(column: str = "canonical"):
    return F.substring_index(column, ".", -1)


# web

APPS = ["fastapi.FastAPI", "fastapi.APIRouter", "fastapi.applications.FastAPI", "fastapi.routing.APIRouter"]


@view("fastapi.routers")
def _(c):
    """Constructor calls with the name they are bound to: the right-most binding on the line at or left of the call."""
    names = c.kind("binding").select("module_id", "line", F.col("column").alias("at"), F.col("symbol").alias("bound"))
    made = calls_of(c, APPS).withColumn("at", F.col("column"))
    return rows(joins.nearest_left(made.select(*BASE, "at", "canonical", "state"), names, ["module_id", "line"], "at", "bound"), F.coalesce("bound", "canonical"), F.col("canonical").alias("kind"))


@view("fastapi.endpoints")
def _(c):
    d = c.canonical(c.kind("decorator")).where(one_of("canonical", [f"{a}.{m}" for a in APPS for m in ROUTES]) | (last_part("canonical").isin(*ROUTES) & F.exists("candidates", lambda s: s.rlike(r"(FastAPI|APIRouter)\.\w+$"))))
    own = VIEWS["fastapi.routers"](c).select(F.col("symbol").alias("router")).distinct()
    via = c.canonical(c.kind("decorator")).where(last_part("canonical").isin(*ROUTES)).withColumn("router", F.regexp_replace("canonical", r"\.\w+$", "")).join(own, "router", "left_semi").drop("router")
    both = d.unionByName(via).dropDuplicates(["module_id", "n"])
    f = c.kind("function").select(F.col("symbol").alias("function"), F.col("attrs")["docstring"].alias("docstring"), F.col("attrs")["is_async"].alias("is_async"))
    return rows(both.join(f, attr("decorated") == F.col("function")), "function", last_part().alias("method"), F.get(F.filter("items", lambda i: i["position"] == 0), F.lit(0))["literal"].alias("route"), keyword("response_model").alias("response_model"), "docstring", "is_async")


@view("fastapi.dependencies")
def _(c):
    """Depends calls inside the default of a parameter."""
    return rows(calls_of(c, ["fastapi.Depends", "fastapi.params.Depends"]).where("position = 'default'"), F.get("items", F.lit(0))["symbol"], "owner")


@view("fastapi.response_models")
def _(c):
    return VIEWS["fastapi.endpoints"](c).where("response_model IS NOT NULL").withColumn("model", F.coalesce("response_model.symbol", "response_model.text"))


# Pydantic

MODEL_BASES = ["pydantic.BaseModel", "pydantic.main.BaseModel"]
CONFIGS = ["pydantic.ConfigDict", "pydantic.config.ConfigDict"]


def model_names(c: Catalog) -> DataFrame:
    return inherits(c, c.classes, "symbol", MODEL_BASES)


@view("pydantic.models")
def _(c):
    return rows(model_names(c), "symbol", "name")


@view("pydantic.fields")
def _(c):
    own = model_names(c).select(F.col("symbol").alias("owner")).distinct()
    t = c.fields.where((attr("annotated") == "true") & (F.col("name") != "model_config")).join(own, "owner", "left_semi").withColumn("state", F.lit("resolved"))
    return rows(t, "symbol", "owner", attr("annotation").alias("annotation"), *(keyword(k)["text"].alias(k) for k in ("default", "default_factory", "alias", "validation_alias", "serialization_alias", "description", "examples")))


@view("pydantic.configs")
def _(c):
    """Configurations as a field (v2 named model_config, v1 named Config; options are the arguments of a ConfigDict call,
    positional ones named by their place) or as a nested class Config (v1; options are its fields)."""
    own = model_names(c).select(F.col("symbol").alias("owner")).distinct()
    pair = lambda name, value: F.struct(name.alias("option"), value.alias("value"))
    of_call = F.transform("items", lambda i: pair(F.coalesce(i["name"], i["position"].cast("string")), i["text"]))
    called = c.canonical(c.fields.where("name IN ('model_config', 'Config')").withColumn("called", attr("value_symbol")), "called")
    direct = (attr("value_kind") == "Call") & one_of("canonical", CONFIGS)
    t = called.join(own, "owner", "left_semi").select(*BASE, "owner", F.when(F.col("name") == "Config", "v1").otherwise("v2").alias("version"), F.when(direct, of_call).otherwise(F.filter(of_call, lambda _: F.lit(False))).alias("options"))
    nested = c.classes.where("name = 'Config'").join(own, "owner", "left_semi").select(*BASE, "owner", F.lit("v1").alias("version"), F.col("symbol").alias("inside"))
    within = c.fields.where(attr("value_kind") != "").select(F.col("owner").alias("inside"), F.struct("line", "column").alias("at"), pair(F.col("name"), attr("value")).alias("option"))
    listed = within.groupBy("inside").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "option"))), lambda x: x["option"]).alias("options"))
    nested = nested.join(listed, "inside", "left").withColumn("options", F.coalesce("options", F.filter(F.array(pair(F.lit(""), F.lit(""))), lambda _: F.lit(False)))).drop("inside")
    return rows(t.unionByName(nested).withColumn("state", F.lit("resolved")), "owner", "version", "options")


def _model_decorators(names: list[str]):
    def plan(c):
        own = model_names(c).select(F.col("symbol").alias("class")).distinct()
        t = c.canonical(c.kind("decorator")).where(one_of("canonical", [f"pydantic.{n}" for n in names])).withColumn("class", F.regexp_replace(attr("decorated"), r"\.\w+$", ""))
        return rows(t.join(own, "class", "left_semi"), attr("decorated"), "class", last_part().alias("kind"))

    return plan


view("pydantic.validators")(_model_decorators(["field_validator", "model_validator", "validator", "root_validator"]))
view("pydantic.serializers")(_model_decorators(["field_serializer", "model_serializer"]))


@view("pydantic.operations")
def _(c):
    """Construct, validate and dump calls on models."""
    kinds = {"model_validate": "validate", "model_validate_json": "validate", "parse_obj": "validate", "model_dump": "dump", "model_dump_json": "dump", "dict": "dump", "json": "dump", "model_construct": "construct"}
    own = model_names(c).select(F.col("symbol").alias("model")).distinct()
    t = c.calls.withColumn("op", F.coalesce(*[F.when(last_part() == k, F.lit(v)) for k, v in kinds.items()]))
    method = t.where("op IS NOT NULL").withColumn("model", F.regexp_replace("canonical", r"\.\w+$", ""))
    made = t.withColumn("op", F.lit("construct")).withColumn("model", F.col("canonical"))
    return rows(method.unionByName(made).join(own, "model", "left_semi"), "model", "op", "owner")


# pytest


@view("pytest.fixtures")
def _(c):
    d = c.canonical(c.kind("decorator")).where(one_of("canonical", ["pytest.fixture", "pytest_asyncio.fixture"]))
    f = c.kind("function").select(F.col("symbol").alias("function"), F.array_sort(F.transform("items", lambda i: i["name"])).alias("depends_on"))
    return rows(d.join(f, attr("decorated") == F.col("function")), "function", "depends_on")


# databases

SQL_BASES = ["sqlalchemy.orm.DeclarativeBase", "sqlalchemy.orm.decl_api.DeclarativeBase", "sqlalchemy.orm.MappedAsDataclass"]
SQL_FACTORIES = ["sqlalchemy.orm.declarative_base", "sqlalchemy.ext.declarative.declarative_base"]
SQL_MAKERS = ["sqlalchemy.orm.sessionmaker", "sqlalchemy.orm.session.sessionmaker", "sqlalchemy.ext.asyncio.async_sessionmaker"]
SQL_SESSIONS = ["sqlalchemy.orm.Session", "sqlalchemy.orm.sessionmaker", "sqlalchemy.ext.asyncio.AsyncSession", "sqlalchemy.ext.asyncio.async_sessionmaker"]


def sql_models(c: Catalog) -> DataFrame:
    """Classes below a declarative base, or below a name that a factory of such bases was bound to."""
    seeds = bound_to(c, SQL_FACTORIES).withColumnRenamed("symbol", "node").union(c.spark.createDataFrame([(b,) for b in SQL_BASES], "node string"))
    down = c.bases.select(F.col("base").alias("src"), F.col("symbol").alias("dst"))
    return c.classes.join(graph.reachable(down, seeds).select(F.col("node").alias("symbol")), "symbol", "left_semi")


@view("sqlalchemy.models")
def _(c):
    return rows(sql_models(c), "symbol", "name")


def _fields_with_calls(models, symbols: list[str]):
    """Calls that stand inside a field of a model: a range in a range."""

    def plan(c):
        own = models(c).select(F.col("symbol").alias("owner")).distinct()
        span = lambda df: df.withColumn("start", F.col("line").cast("long")).withColumn("end", F.col("end_line").cast("long"))
        call = span(calls_of(c, symbols)).select("module_id", "owner", "start", "end", "canonical", "state", "items", "column")
        field = span(c.fields.join(own, "owner", "left_semi")).select(*BASE, "owner", "symbol", "start", F.greatest("end", F.col("start") + 20).alias("end"))
        t = joins.containment_join(field, call, ["module_id", "owner"]).where("inner_column >= column OR inner_start > line")
        nearest = t.groupBy("module_id", "owner", "inner_start", "inner_column").agg(F.max_by(F.struct("path", "line", "column", "symbol", "inner_canonical", "inner_state", "inner_items"), F.struct("line", "column")).alias("f"))
        t = nearest.select("module_id", "owner", "f.*").withColumn("state", F.col("inner_state"))
        return rows(t, "symbol", "owner", F.col("inner_canonical").alias("kind"), F.transform("inner_items", lambda i: F.struct(i["name"].alias("name"), i["text"].alias("value"))).alias("arguments"))

    return plan


view("sqlalchemy.mapped_columns")(_fields_with_calls(sql_models, ["sqlalchemy.orm.mapped_column", "sqlalchemy.Column", "sqlalchemy.schema.Column"]))
view("sqlalchemy.relationships")(_fields_with_calls(sql_models, ["sqlalchemy.orm.relationship"]))


@view("sqlalchemy.sessions")
def _(c):
    """Calls of session types and factories, and of names a factory was bound to."""
    stored = bound_to(c, SQL_MAKERS).withColumnRenamed("symbol", "canonical")
    return rows(calls_of(c, SQL_SESSIONS).unionByName(c.calls.join(stored, "canonical", "left_semi").select(*c.calls.columns)), "canonical", "owner")


def _library_calls(prefixes: list[str], operations: list[str]):
    def plan(c):
        return rows(c.calls.where(under("canonical", prefixes) & last_part().isin(*operations)), "canonical", "owner", last_part().alias("operation"))

    return plan


view("sqlalchemy.transactions")(_library_calls(["sqlalchemy"], ["begin", "begin_nested", "commit", "rollback"]))
view("sqlalchemy.queries")(_library_calls(["sqlalchemy"], ["select", "insert", "update", "delete", "execute", "scalar", "scalars"]))


@view("sqlalchemy.raw_sql")
def _(c):
    first = F.get(F.filter("items", lambda i: i["position"] == 0), F.lit(0))
    t = c.calls.where(one_of("canonical", ["sqlalchemy.text", "sqlalchemy.sql.expression.text"]) | under("canonical", ["sqlalchemy"]) & (last_part() == "exec_driver_sql") | under("canonical", ["sqlalchemy"]) & (last_part() == "execute") & first["kind"].isin("Constant", "Name", "JoinedStr"))
    return rows(t, "canonical", "owner", (first["kind"] == "Constant").alias("literal"), (first["kind"] == "JoinedStr").alias("dynamic"))


def tortoise_models(c: Catalog) -> DataFrame:
    return inherits(c, c.classes, "symbol", ["tortoise.models.Model", "tortoise.Model"])


TORTOISE_FIELDS = [f"tortoise.fields.{n}Field" for n in ("Int", "BigInt", "SmallInt", "Char", "Text", "Boolean", "Decimal", "Datetime", "Date", "Time", "TimeDelta", "Float", "JSON", "UUID", "Binary", "CharEnum", "IntEnum")]
view("tortoise.models")(lambda c: rows(tortoise_models(c), "symbol", "name"))
view("tortoise.fields")(_fields_with_calls(tortoise_models, TORTOISE_FIELDS))
view("tortoise.relationships")(_fields_with_calls(tortoise_models, [f"tortoise.fields.{n}" for n in ("ForeignKeyField", "OneToOneField", "ManyToManyField")]))
view("tortoise.connections")(_library_calls(["tortoise"], ["init", "get_connection", "close_connections", "connection"]))
view("tortoise.transactions")(_library_calls(["tortoise"], ["in_transaction", "atomic", "commit", "rollback"]))
WRITES = ("create", "bulk_create", "update", "bulk_update", "delete", "save", "get_or_create", "update_or_create")
READS = ("filter", "get", "get_or_none", "all", "first", "exclude", "count", "exists", "values", "values_list")


@view("tortoise.queries")
def _(c):
    """Query calls on models or their chains, and is_write."""
    own = tortoise_models(c).select(F.col("symbol").alias("model")).distinct()
    t = c.calls.where(last_part().isin(*WRITES, *READS)).withColumn("model", F.regexp_replace("canonical", r"(\.\w+)$", ""))
    near = t.join(own, "model", "left_semi").unionByName(t.where(under("canonical", ["tortoise"]))).dropDuplicates(["module_id", "n"])
    return rows(near, "canonical", "owner", last_part().isin(*WRITES).alias("is_write"))


@view("tortoise.raw_sql")
def _(c):
    own = tortoise_models(c).select(F.concat("symbol", F.lit(".raw")).alias("canonical"))
    t = c.calls.where(under("canonical", ["tortoise"]) & last_part().isin("execute_query", "execute_script", "execute_query_dict", "execute_insert", "execute_many", "raw", "RawSQL"))
    return rows(t.unionByName(c.calls.join(own, "canonical", "left_semi").select(*c.calls.columns)), "canonical", "owner")


# what every project has

view("core.syntax")(lambda c: c.facts.where("kind IN ('class', 'function', 'field', 'decorator', 'call')"))
view("core.bindings")(lambda c: c.kind("binding"))
view("core.imports")(lambda c: c.import_edges)
view("core.uses")(lambda c: c.kind("reference"))


def capability(c: Catalog, name: str) -> DataFrame | None:
    """A view by name; None if there is no such view, which a rule reports as a missing capability."""
    return VIEWS[name](c) if name in VIEWS else None
