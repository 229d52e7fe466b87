"""Pairs of sources, one that breaks a rule and one that keeps it, checked together as one project."""

import pytest

from lattica.plans.report import check, check_sources
from lattica.sources.policy import PolicyError, complete, load_document, merge
from lattica.sources.scan import scan

ROLES = {n: {"include": [f"app/{n}/*"]} for n in ("router", "service", "model", "adapter", "dto", "schema", "configuration", "query", "contract", "task")}
POLICY = {
    "roles": ROLES,
    "allow": {n: sorted(ROLES) for n in ROLES} | {"model": ["model"]},
    "zones": {"test": ["tests/*"]},
    "transaction": {"owner_roles": ["service"], "session_providers": ["app.db.session"], "boundary_decorators": ["app.db.atomic"]},
    "boundaries": [{"name": "no_models", "roles": ["task"], "forbidden_imports": ["app.model"], "forbidden_calls": ["pickle.*"]}],
    "code_conventions": {"raw_test_http_calls": ["httpx.get"]},
}
FILES = {
    "app/__init__.py": "",
    "app/db.py": "import contextlib\n@contextlib.contextmanager\ndef session():\n    yield\ndef atomic(f):\n    return f\n",
    "app/model/user.py": "import app.router.api\nfrom sqlalchemy import DateTime, Enum, text\nx = DateTime()\ny = DateTime(timezone=True)\nz = Enum('A')\nq = text('select 1')\n",
    "app/router/api.py": 'from fastapi import APIRouter, HTTPException\nfrom app.service import work\nrouter = APIRouter(tags=["x"])\n@router.get("/a")\ndef a():\n    raise HTTPException(400)\n@router.get("/b", responses={}, response_model=None)\ndef b():\n    "Doc."\n',
    "app/service/work.py": "import datetime\nimport time\nimport httpx\nfrom app.db import session, atomic\nasync def slow():\n    helper()\n    time.sleep(1)\nasync def fine():\n    other()\ndef helper():\n    open('x')\ndef other():\n    pass\ndef now():\n    return datetime.datetime.now()\ndef local():\n    import json\n    with session():\n        session()\n",
    "app/adapter/http.py": "import httpx\nimport importlib\ndef get() -> httpx.Response:\n    httpx.Client()\n    return httpx.Client(timeout=3)\nimportlib.import_module('x')\n",
    "app/dto/user.py": "import dataclasses\nfrom dataclasses import dataclass\n@dataclass\nclass UserData:\n    names: list[str]\n@dataclass(frozen=True)\nclass UserRow:\n    name: str\n@dataclass(frozen=True)\nclass Person:\n    name: str\n",
    "app/schema/user.py": "from pydantic import BaseModel, Field\nfrom enum import StrEnum\nclass UserSnapshot(BaseModel):\n    a: int\n    b: int = Field(description='b', examples=[1])\nclass Kind(StrEnum):\n    bad = 'x'\n    GOOD = 'y'\n",
    "app/task/job.py": "import pickle\nimport os\nfrom app.model import user\npickle.loads(b'')\nkey = os.getenv('X')  # lattica: ignore[SEC001]\nroot = os.environ\n",
    "app/loop_a.py": "import app.loop_b\n",
    "app/loop_b.py": "import app.loop_a  # lattica: ignore[TIME001]\n",
    "app/broken.py": "def (:\n",
    "tests/unit/conftest.py": "",
    "tests/test_x.py": "import httpx\ndef test_a():\n    httpx.get('x')\n",
    "app/stub.pyi": "",
    "app/stub.py": "x: int = 1\n",
    "node_modules/skip.py": "",
    "app/9 odd-name.py": "",
}
EXPECTED = {
    "ARCH000": {"app", "app.db", "app.loop_a", "app.loop_b", "app.stub", "tests.unit.conftest", "tests.test_x"},
    "ARCH001": {"app.model.user"},
    "ARCH002": set(),  # a file can't be read, so no cycle is certain
    "BOUNDARY001": {"app.task.job"},
    "BOUNDARY002": {"app.service.work"},
    "ENTRY001": {"app.router.api"},
    "TIME001": {"app.service.work"},
    "ASYNC001": {"app.service.work"},
    "IMPORT001": {"app.service.work"},
    "IMPORT002": {"app.adapter.http"},
    "HTTP001": {"app.adapter.http"},
    "ADAPTER002": {"app.adapter.http"},
    "SEC001": {"app.task.job"},
    "SESSION002": {"app.service.work"},
    "DB001": {"app.model.user"},
    "ORM002": {"app.model.user"},
    "SQL001": {"app.model.user"},
    "DTO001": {"app.dto.user"},
    "DTO002": {"app.dto.user"},
    "SNAPSHOT001": {"app.schema.user"},
    "API001": {"app.router.api"},
    "API002": {"app.schema.user"},
    "ENUM001": {"app.schema.user"},
    "TEST001": {"tests.unit.conftest"},
    "TEST002": {"tests.test_x"},
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def report(spark, project):
    return check(spark, str(project), complete(POLICY))


@pytest.fixture(scope="module")
def findings(report):
    return report.findings.collect()


def test_scan(spark, project):
    sources, issues = scan(spark, str(project))
    got = {r.path: (r.module_id, r.status, r.is_package) for r in sources.collect()}
    assert got["app/stub.pyi"][1] == "shadowed_stub" and got["node_modules/skip.py"][1] == "excluded"
    assert got["app/__init__.py"] == ("app", "analyzed", True)
    assert got["app/9 odd-name.py"][0].startswith("app._9_odd_name_") and len(got["app/9 odd-name.py"][0]) == len("app._9_odd_name_") + 8
    assert issues.count() == 0


@pytest.mark.parametrize("rule", sorted(EXPECTED))
def test_rule_finds_what_breaks_it_and_nothing_else(findings, rule):
    got = {f.module_id for f in findings if f.rule_id == rule}
    assert {m for m in got if "odd" not in m} == EXPECTED[rule]


def test_lines_of_findings(findings):
    lines = lambda rule: sorted(f.line for f in findings if f.rule_id == rule)
    assert lines("ASYNC001") == [5, 6] and lines("HTTP001") == [3] and lines("DB001") == [2] and lines("IMPORT001") == [16]
    assert lines("BOUNDARY001") == [2, 3] and lines("SEC001") == [4, 5] and lines("API001") == [3]


def test_suppression_and_decision(report, findings):
    ignored = [f for f in findings if f.disposition == "ignored"]
    assert [(f.rule_id, f.line) for f in ignored] == [("SEC001", 4)]
    assert [r.path for r in report.unused_ignores.collect()] == ["app/loop_b.py"]
    assert report.exit_code == 2  # a file could not be read
    verdicts = {(r.rule_id, r.verdict) for r in report.evaluations.where("module_id = 'app.broken'").collect()}
    assert {v for _, v in verdicts} == {"indeterminate"}
    open_ = {(r.rule_id, r.reason) for r in report.evaluations.where("module_id = 'app.loop_a' AND verdict = 'indeterminate'").collect()}
    assert {("ARCH002", "incomplete_project"), ("EXC001", "incomplete_project"), ("BOUNDARY001", "missing_role")} <= open_
    of = {r.rule_id: r.verdict for r in report.evaluations.where("module_id = 'app.dto.user'").collect()}
    assert of["DTO001"] == "fail" and of["BOUNDARY002"] == of["IGNORE001"] == "not_applicable" and of["ARCH001"] == "pass"
    c = {r.rule_id: r for r in report.coverage.collect()}
    assert all(r.total == r["pass"] + r["fail"] + r.not_applicable + r.indeterminate for r in c.values())


def test_same_bytes_again(spark, project, report):
    assert check(spark, str(project), complete(POLICY)).to_json() == report.to_json()


def test_clean_project_passes(spark):
    rows = [("app/service/a.py", "app.service.a", False, "x = 1\n", "h", 1, "analyzed")]
    sources = spark.createDataFrame(rows, "path string, module_id string, is_package boolean, content string, content_hash string, line_count int, status string")
    assert check_sources(sources, complete(POLICY), rules=["ARCH000", "ARCH001", "ASYNC001", "IMPORT001", "SIZE001"]).exit_code == 0


def test_policy_documents(spark, tmp_path):
    (tmp_path / "base.toml").write_text('[tool.lattica]\nstrict = true\n[tool.lattica.zones]\ntest = ["tests/*"]\n')
    (tmp_path / "pyproject.toml").write_text('[tool.lattica]\nextend = "base.toml"\n[tool.lattica.roles.service]\ninclude = ["app/*"]\n')
    doc = load_document(spark, str(tmp_path / "pyproject.toml"), "lattica")
    assert doc["zones"] == {"test": ["tests/*"]} and "service" in doc["roles"]
    assert merge({"a": {"b": [1]}}, {"a": {"b": [2], "c": 3}}) == {"a": {"b": [2], "c": 3}}
    done = complete({"roles": {"a": ["a/*"]}, "allow": {"a": ["a"]}, "max_lines": 9, "default_zone": "script", "external": {"timeout_calls": ["x.y"]}, "effects": [{"symbols": ["m.f", "m.g"], "effects": ["io.blocking"]}, {"symbol": "time.sleep", "effects": ["io.blocking"]}]})
    assert done["roles"][0]["include"] == ["a/*"] and done["max_lines"] == 9 and "x.y" in done["boundaries"]["http_timeout_calls"] and done["effects"]["m.g"] == (["io.blocking"], "direct")
    with pytest.raises(PolicyError):
        complete({"effects": [{"symbol": "time.sleep", "effects": []}]})
    with pytest.raises(PolicyError):
        complete({"nonsense": 1})
    with pytest.raises(PolicyError):
        complete({"roles": {"a": {"include": ["x"]}}, "allow": {"a": ["b"]}})
