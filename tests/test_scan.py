"""Source roots and files that can't be read."""

import pytest

from lattica.plans.assurance import audit
from lattica.plans.report import check
from lattica.sources.policy import complete
from lattica.sources.scan import scan


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    for path, content in {"src/a.py": b"x = 1\n", "src/plug/b.py": b"", "docs/c.py": b"x = 1\n", "src/odd.py": b"x\xff"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    return str(root)


def test_source_roots(spark, tree):
    sources, issues = scan(spark, tree, ["./src/", "src/plug", "../other", "nowhere"])
    assert {(r.path, r.module_id, r.status) for r in sources.collect()} == {("src/a.py", "a", "analyzed"), ("src/plug/b.py", "b", "analyzed")}
    assert {(r.code, r.path) for r in issues.collect()} == {("SOURCE_ROOT_OUTSIDE", "../other"), ("SOURCE_ROOT_MISSING", "nowhere"), ("SOURCE_READ_FAILURE", "src/odd.py")}


def test_without_usable_roots_there_are_no_sources(spark, tree):
    sources, issues = scan(spark, tree, ["nowhere"])
    assert sources.count() == 0
    assert {r.code for r in issues.collect()} == {"SOURCE_ROOT_MISSING", "NO_SOURCES"}


def test_the_project_itself_is_the_default_root(spark, tree):
    assert {r.module_id for r in scan(spark, tree)[0].collect()} == {"src.a", "src.plug.b", "docs.c"}


def test_audit_of_roles_and_kinds_of_symbols(spark, tmp_path):
    files = {
        "app/plain/web.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/')\ndef f():\n    pass\n",
        "app/router/web.py": "from fastapi import APIRouter\nrouter = APIRouter()\n@router.get('/')\ndef f():\n    pass\n",
        "app/plain/orm.py": "from sqlalchemy.orm import DeclarativeBase\nclass Base(DeclarativeBase):\n    pass\n",
        "app/plain/db.py": "PROVIDER = 1\ndef session():\n    yield\n",
    }
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    roles = {r: {"include": [f"app/{r}/*"]} for r in ("plain", "router")}
    policy = complete({"roles": roles, "transaction": {"session_providers": ["app.plain.db.session", "app.plain.db.PROVIDER", "app.plain.db.nope"]}, "boundary_extensions": {"adapter_implementation_symbols": ["app.plain.db.session"]}})
    got = {(r.code, r.subject, r.detail) for r in audit(check(spark, str(tmp_path), policy)).collect()}
    assert got == {
        ("ROLE_SEMANTIC_MISMATCH", "app/plain/web.py", "endpoint in role plain"),
        ("ROLE_SEMANTIC_MISMATCH", "app/plain/orm.py", "SQLAlchemy model in role plain"),
        ("POLICY_SYMBOL_UNRESOLVED", "app.plain.db.nope", ""),
        ("POLICY_SYMBOL_KIND_MISMATCH", "app.plain.db.PROVIDER", "no callable"),
        ("POLICY_SYMBOL_KIND_MISMATCH", "app.plain.db.session", "no class"),
    }
