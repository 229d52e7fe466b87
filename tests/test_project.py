"""Capability views, audits, incremental checks, streams and the command line over small projects."""

import io
import random

import pytest
from pyspark.sql import functions as F
from test_check import FILES, POLICY

from lattica.cli import main
from lattica.operators.joins import snapshot_diff
from lattica.plans.assurance import audit, observe
from lattica.plans.capabilities import VIEWS, capability
from lattica.plans.facts import Catalog
from lattica.plans.onboarding import propose
from lattica.plans.report import check, check_sources, columns, wrapped
from lattica.sources.policy import complete
from lattica.streaming.incremental import SOURCE, Session, follow, impacted, missed, semantic_digests

FRAMEWORKS = {
    "app/web.py": 'from fastapi import APIRouter, Depends\nfrom pydantic import BaseModel, ConfigDict, Field, field_validator\nimport pytest\nclass Out(BaseModel):\n    model_config = ConfigDict(frozen=True)\n    a: int = Field(default=1, description="x")\n    @field_validator("a")\n    def check(cls, v):\n        return v\nclass Sub(Out):\n    b: str\nrouter = APIRouter()\ndef dep():\n    return 1\n@router.get("/a", response_model=Out)\nasync def endpoint(x=Depends(dep)):\n    return Out.model_validate({})\n@pytest.fixture\ndef client(base):\n    return base\n',
    "app/orm.py": 'from sqlalchemy.orm import DeclarativeBase, mapped_column, relationship, sessionmaker, Session\nfrom sqlalchemy import select, text\nclass Base(DeclarativeBase):\n    pass\nclass User(Base):\n    id = mapped_column(primary_key=True)\n    pets = relationship("Pet", lazy="raise")\nmake = sessionmaker()\ndef run(s: Session):\n    s.execute(select(User))\n    s.commit()\n    text("x")\n',
    "app/tort.py": "from tortoise import fields\nfrom tortoise.models import Model\nclass Cat(Model):\n    id = fields.IntField(pk=True)\n    owner = fields.ForeignKeyField('x')\nasync def go():\n    await Cat.filter(id=1)\n    await Cat.create(id=2)\n",
}


def table(spark, files):
    rows = [(p, p[:-3].replace("/", "."), False, t, str(hash(t)), t.count("\n"), "analyzed") for p, t in files.items()]
    return spark.createDataFrame(rows, SOURCE)


@pytest.fixture(scope="module")
def frameworks(spark):
    return Catalog(table(spark, FRAMEWORKS), complete({}))


EXPECTED = {
    "fastapi.routers": {"app.web.router"},
    "fastapi.endpoints": {"app.web.endpoint"},
    "fastapi.dependencies": {"app.web.dep"},
    "fastapi.response_models": {"app.web.endpoint"},
    "pydantic.models": {"app.web.Out", "app.web.Sub"},
    "pydantic.fields": {"app.web.Out.a", "app.web.Sub.b"},
    "pydantic.configs": {"app.web.Out"},
    "pydantic.validators": {"app.web.Out.check"},
    "pydantic.operations": {"app.web.Out"},
    "pytest.fixtures": {"app.web.client"},
    "sqlalchemy.models": {"app.orm.Base", "app.orm.User"},
    "sqlalchemy.mapped_columns": {"app.orm.User.id"},
    "sqlalchemy.relationships": {"app.orm.User.pets"},
    "sqlalchemy.sessions": {"sqlalchemy.orm.sessionmaker"},
    "sqlalchemy.transactions": {"sqlalchemy.orm.Session.commit"},
    "sqlalchemy.raw_sql": {"sqlalchemy.text"},
    "tortoise.models": {"app.tort.Cat"},
    "tortoise.fields": {"app.tort.Cat.id"},
    "tortoise.relationships": {"app.tort.Cat.owner"},
    "tortoise.queries": {"app.tort.Cat.filter", "app.tort.Cat.create"},
}


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_capability(frameworks, name):
    got = capability(frameworks, name)
    if name in EXPECTED:
        assert {r.symbol for r in got.select("symbol").collect()} == EXPECTED[name]
    else:
        got.count()
    assert capability(frameworks, "nonsense") is None


def plain(report):
    return sorted(tuple(r) for r in report.findings.select("rule_id", "path", "line", "column", "symbol", "subject", "disposition").collect()), sorted(map(tuple, report.evaluations.collect())), report.exit_code


def test_revisions_give_what_a_fresh_check_gives(spark):
    policy, r = complete(POLICY), random.Random(1)
    files = {p: t for p, t in FILES.items() if p.endswith(".py") and "odd" not in p and "node" not in p}
    rules = ["ARCH001", "ARCH002", "ASYNC001", "TIME001"]
    session = Session(spark, policy)
    session.check(table(spark, files))
    before = session.catalog
    for edit in ("change", "add", "delete", "break"):
        path = r.choice(sorted(files))
        if edit == "add":
            files["app/service/new.py"] = "import time\nasync def a():\n    time.sleep(1)\n"
        elif edit == "delete":
            del files[path]
        else:
            files[path] = "def (" if edit == "break" else "import datetime\nx = datetime.datetime.now()\n" + files[path]
    report = session.check(table(spark, files))
    fresh = check_sources(table(spark, files), policy)
    assert plain(report) == plain(fresh)
    del rules
    touched = impacted(session.changes, before, session.catalog)
    edges = lambda c: c.import_edges.groupBy("importer").agg(F.sort_array(F.collect_set("target")).alias("t"))
    moved = snapshot_diff(edges(before), edges(session.catalog), "importer", "t").select(F.col("importer").alias("node"))
    assert missed(touched, moved).count() == 0


CALLBACKS = """
import time
def call(f):
    f()
def forward(g, other=None):
    call(g)
def maybe(f):
    if f:
        f()
def rebound(f):
    f = print
    f()
async def direct():
    call(time.sleep)
async def through():
    forward(time.sleep)
async def harmless():
    forward(print, other=time.sleep)
async def gone():
    rebound(time.sleep)
def helper():
    forward(time.sleep)
async def deep():
    helper()
async def wrong():
    call(time.sleep, 1)
"""


def test_callbacks_carry_their_effects(spark):
    c = Catalog(table(spark, {"m.py": CALLBACKS}), complete({}))
    assert {(r.node, r.certain) for r in c.callbacks.collect()} == {("m.call.f", True), ("m.forward.g", True), ("m.maybe.f", False)}
    report = check_sources(table(spark, {"m.py": CALLBACKS}), complete({}), rules=["ASYNC001"])
    assert {r.subject for r in report.findings.collect()} == {"m.direct", "m.through", "m.deep"}


def test_semantic_digests_ignore_places(spark):
    a = Catalog(table(spark, {"m.py": "x = 1\ndef f(a):\n    return g(a)\n"}), complete({}))
    b = Catalog(table(spark, {"m.py": "# moved\n\nx = 1\n\ndef f(a):\n    return g(a)\n"}), complete({}))
    c = Catalog(table(spark, {"m.py": "x = 1\ndef f(a):\n    return h(a)\n"}), complete({}))
    da, db, dc = (semantic_digests(k.facts).first().digest for k in (a, b, c))
    assert da == db != dc


def test_semantic_digests_see_the_end_of_long_values(spark):
    long = ", ".join(map(str, range(1000)))
    a, b = (Catalog(table(spark, {"m.py": f"def f():\n    return g([{long}, {last}])\n"}), complete({})) for last in ("'a'", "'b'"))
    assert semantic_digests(a.facts).first().digest != semantic_digests(b.facts).first().digest


def test_stream_of_edits(spark, tmp_path):
    schema = "revision long, path string, module_id string, is_package boolean, content string, deleted boolean"
    edits = [(1, "app/service/a.py", "app.service.a", False, "import datetime\n", False), (2, "app/service/a.py", "app.service.a", False, "import datetime\nx = datetime.datetime.now()\n", False)]
    spark.createDataFrame(edits, schema).write.parquet(str(tmp_path / "in"))
    session = Session(spark, complete(POLICY))
    query = follow(session, spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.rule_id, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("TIME001", 1)}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for member in ("one", "two"):
        (root / member / "app/service").mkdir(parents=True)
        (root / member / "app/service/a.py").write_text("import datetime\nx = datetime.datetime.now()\n" if member == "two" else "x = 1\n")
        (root / member / "pyproject.toml").write_text('[tool.lattica.roles.service]\ninclude = ["app/service/*"]\n[tool.lattica.roles.ghost]\ninclude = ["nowhere/*"]\n[tool.lattica.assurance.features]\napi = "required"\n')
    (root / "pyproject.toml").write_text('[tool.lattica.workspace]\nmembers = ["one", "two"]\n')
    return root


def test_command_line(spark, tree):
    run = lambda *a: (main([*a], out := io.StringIO()), out.getvalue())
    assert run("check", f"{tree}/one")[0] == 0
    code, text = run("check", str(tree))
    assert code == 1 and "app/service/a.py:2:5: TIME001" in text
    code, text = run("audit", f"{tree}/one")
    assert code == 2 and "ROLE_SELECTOR_UNUSED ghost" in text and "FEATURE_REQUIRED_MISSING api" in text
    assert run("config", f"{tree}/one")[0] == 0 and run("config", f"{tree}/none")[0] == 2
    assert run("rules")[1].count("\n") == 49


def test_proposal(spark, tmp_path):
    for name, text in {"app/services/a.py": "import app.models.m\n", "app/models/m.py": "import app.routers.r\n", "app/routers/r.py": "import app.services.a\n", "tests/test_a.py": "", "app/odd.py": "x = 1\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    p = propose(spark, str(tmp_path))
    assert p["roles"] == {"model": ["app/models/*"], "router": ["app/routers/*"], "service": ["app/services/*"]}
    assert p["risky"] == ["model>router", "router>service", "service>model"] and "role of app/odd.py" in p["questions"]
    answers = {"project_digest": p["project_digest"], "risky": {"model>router": "deny", "router>service": "allow", "service>model": "allow"}}
    done = propose(spark, str(tmp_path), answers)
    assert done["allow"] == {"model": ["model"], "router": ["router", "service"], "service": ["model", "service"]}
    (tmp_path / "pyproject.toml").write_text(done["toml"])
    assert {f.rule_id for f in check(spark, str(tmp_path)).findings.collect()} >= {"ARCH001"}
    with pytest.raises(ValueError):
        propose(spark, str(tmp_path), {"project_digest": "old"})


def test_wrapping():
    assert columns("aé漢") == 4
    assert wrapped("aaaa bbbb cccc", 9) == ["aaaa bbbb", "    cccc"]


def test_audit_and_observation(spark, tree):
    report = check(spark, f"{tree}/two", complete({"roles": {"service": {"include": ["app/*"]}}, "exclusions": [{"patterns": ["gone/*"], "reason": "x"}], "transaction": {"session_providers": ["app.service.nope"]}, "approvals": [{"rule": "TIME001", "symbol": "app.service.a", "reason": "x"}, {"rule": "ARCH001", "symbol": "q", "reason": "x"}]}))
    assert report.exit_code == 0
    got = {(r.code, r.subject) for r in audit(report).collect()}
    assert {("EXCLUSION_UNUSED", "gone/*"), ("POLICY_SYMBOL_UNRESOLVED", "app.service.nope"), ("APPROVAL_UNUSED", "ARCH001:q"), ("APPROVAL_BUDGET_EXCEEDED", "1")} == got
    assert observe(report)["size_limits"].first().max_lines == 200
