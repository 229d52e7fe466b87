"""A project with modules that use each framework, modules that only look as if they did, and what each view must show.

A framework has three forms of modules. The first writes names out by `from ... import`, the second through aliases of
modules, the third defines its own names that are spelled like the framework's, so that no view may show it. The
registered queries write a module for each row of a table, in the form that the row's number falls on.
"""

SOURCES = {
    "fastapi": [
        "from fastapi import APIRouter, Depends\nrouter = APIRouter()\ndef dep():\n    return 1\n@router.get('/a', response_model=int)\nasync def get(x=Depends(dep)):\n    'Doc.'\n@router.post('/b')\ndef post():\n    pass\n",
        "import fastapi as f\napp = f.FastAPI()\ndef dep():\n    return 1\n@app.delete('/c')\ndef drop(x=f.Depends(dep)):\n    pass\n",
        "class APIRouter:\n    def get(self, path):\n        return lambda f: f\ndef Depends(f):\n    return f\nrouter = APIRouter()\n@router.get('/a')\ndef get(x=Depends(len)):\n    pass\n",
    ],
    "pydantic": [
        "from pydantic import BaseModel, ConfigDict, Field, field_serializer, field_validator\nclass Out(BaseModel):\n    model_config = ConfigDict(frozen=True)\n    a: int = Field(default=1, description='x')\n    @field_validator('a')\n    def check(cls, v):\n        return v\n    @field_serializer('a')\n    def show(self, v):\n        return v\nclass Sub(Out):\n    b: str\ndef f(x):\n    return Out.model_validate(x)\n",
        "import pydantic as p\nclass Row(p.BaseModel):\n    c: float = p.Field(alias='y')\n    class Config:\n        extra = 'forbid'\ndef f():\n    return Row(c=1.0)\n",
        "class BaseModel:\n    pass\nclass Out(BaseModel):\n    a: int = 1\ndef f():\n    return Out()\n",
    ],
    "pytest": [
        "import pytest\n@pytest.fixture\ndef base():\n    return 1\n@pytest.fixture(scope='module')\ndef client(db, base):\n    return base\ndef test_x(client):\n    pass\n",
        "from pytest import fixture as made\n@made\ndef one():\n    return 1\n",
        "def fixture(f):\n    return f\n@fixture\ndef one():\n    return 1\n",
    ],
    "sqlalchemy": [
        "from sqlalchemy.orm import DeclarativeBase, Session, mapped_column, relationship, sessionmaker\nfrom sqlalchemy import select, text\nclass Base(DeclarativeBase):\n    pass\nclass User(Base):\n    id = mapped_column(primary_key=True)\n    pets = relationship('Pet', lazy='raise')\nmake = sessionmaker()\ndef run(s: Session):\n    s.execute(select(User))\n    s.commit()\n    text('x')\n",
        "import sqlalchemy as sa\nfrom sqlalchemy import orm\nBase = orm.declarative_base()\nmake = orm.sessionmaker()\nclass Pet(Base):\n    id = sa.Column(primary_key=True)\ndef run(q):\n    make()\n    with orm.Session() as s:\n        s.rollback()\n    return sa.text(q)\n",
        "def select(x):\n    return x\nclass Base:\n    pass\nclass User(Base):\n    id = select(1)\ndef run(s):\n    s.commit()\n",
    ],
    "tortoise": [
        "from tortoise import fields\nfrom tortoise.models import Model\nclass Cat(Model):\n    id = fields.IntField(pk=True)\n    owner = fields.ForeignKeyField('x')\nasync def go():\n    await Cat.filter(id=1)\n    await Cat.create(id=2)\n",
        "import tortoise.models as m\nfrom tortoise import Tortoise, transactions\nclass Dog(m.Model):\n    pass\nasync def go():\n    await Tortoise.init()\n    async with transactions.in_transaction():\n        await Dog.raw('x')\n",
        "class Model:\n    @classmethod\n    def filter(cls):\n        return cls\nclass Cat(Model):\n    pass\ndef go():\n    Cat.filter()\n",
    ],
}

#: By framework: (form, view, symbol, the view's own columns as JSON). {m} is the module's name.
SHOWN = {
    "fastapi": [
        (0, "fastapi.routers", "{m}.router", '{"kind":"fastapi.APIRouter"}'),
        (0, "fastapi.endpoints", "{m}.get", '{"method":"get","route":"\'/a\'","docstring":"true","is_async":"true"}'),
        (0, "fastapi.endpoints", "{m}.post", '{"method":"post","route":"\'/b\'","docstring":"false","is_async":"false"}'),
        (0, "fastapi.dependencies", "{m}.dep", '{"owner":"{m}"}'),
        (0, "fastapi.response_models", "{m}.get", '{"method":"get","route":"\'/a\'","docstring":"true","is_async":"true","model":"builtins.int"}'),
        (1, "fastapi.routers", "{m}.app", '{"kind":"fastapi.FastAPI"}'),
        (1, "fastapi.endpoints", "{m}.drop", '{"method":"delete","route":"\'/c\'","docstring":"false","is_async":"false"}'),
        (1, "fastapi.dependencies", "{m}.dep", '{"owner":"{m}"}'),
    ],
    "pydantic": [
        (0, "pydantic.models", "{m}.Out", '{"name":"Out"}'),
        (0, "pydantic.models", "{m}.Sub", '{"name":"Sub"}'),
        (0, "pydantic.fields", "{m}.Out.a", '{"owner":"{m}.Out","annotation":"int","default":"1","description":"\'x\'"}'),
        (0, "pydantic.fields", "{m}.Sub.b", '{"owner":"{m}.Sub","annotation":"str"}'),
        (0, "pydantic.configs", "{m}.Out", '{"version":"v2","options":[{"option":"frozen","value":"True"}]}'),
        (0, "pydantic.validators", "{m}.Out.check", '{"class":"{m}.Out","kind":"field_validator"}'),
        (0, "pydantic.serializers", "{m}.Out.show", '{"class":"{m}.Out","kind":"field_serializer"}'),
        (0, "pydantic.operations", "{m}.Out", '{"op":"validate","owner":"{m}.f"}'),
        (1, "pydantic.models", "{m}.Row", '{"name":"Row"}'),
        (1, "pydantic.fields", "{m}.Row.c", '{"owner":"{m}.Row","annotation":"float","alias":"\'y\'"}'),
        (1, "pydantic.configs", "{m}.Row", '{"version":"v1","options":[{"option":"extra","value":"\'forbid\'"}]}'),
        (1, "pydantic.operations", "{m}.Row", '{"op":"construct","owner":"{m}.f"}'),
    ],
    "pytest": [
        (0, "pytest.fixtures", "{m}.base", '{"depends_on":[]}'),
        (0, "pytest.fixtures", "{m}.client", '{"depends_on":["base","db"]}'),
        (1, "pytest.fixtures", "{m}.one", '{"depends_on":[]}'),
    ],
    "sqlalchemy": [
        (0, "sqlalchemy.models", "{m}.Base", '{"name":"Base"}'),
        (0, "sqlalchemy.models", "{m}.User", '{"name":"User"}'),
        (0, "sqlalchemy.mapped_columns", "{m}.User.id", '{"owner":"{m}.User","kind":"sqlalchemy.orm.mapped_column","arguments":[{"name":"primary_key","value":"True"}]}'),
        (0, "sqlalchemy.relationships", "{m}.User.pets", '{"owner":"{m}.User","kind":"sqlalchemy.orm.relationship","arguments":[{"value":"\'Pet\'"},{"name":"lazy","value":"\'raise\'"}]}'),
        (0, "sqlalchemy.sessions", "sqlalchemy.orm.sessionmaker", '{"owner":"{m}"}'),
        (0, "sqlalchemy.transactions", "sqlalchemy.orm.Session.commit", '{"owner":"{m}.run","operation":"commit"}'),
        (0, "sqlalchemy.queries", "sqlalchemy.orm.Session.execute", '{"owner":"{m}.run","operation":"execute"}'),
        (0, "sqlalchemy.queries", "sqlalchemy.select", '{"owner":"{m}.run","operation":"select"}'),
        (0, "sqlalchemy.raw_sql", "sqlalchemy.text", '{"owner":"{m}.run","literal":true,"dynamic":false}'),
        (1, "sqlalchemy.models", "{m}.Pet", '{"name":"Pet"}'),
        (1, "sqlalchemy.mapped_columns", "{m}.Pet.id", '{"owner":"{m}.Pet","kind":"sqlalchemy.Column","arguments":[{"name":"primary_key","value":"True"}]}'),
        (1, "sqlalchemy.sessions", "sqlalchemy.orm.sessionmaker", '{"owner":"{m}"}'),
        (1, "sqlalchemy.sessions", "{m}.make", '{"owner":"{m}.run"}'),
        (1, "sqlalchemy.sessions", "sqlalchemy.orm.Session", '{"owner":"{m}.run"}'),
        (1, "sqlalchemy.transactions", "sqlalchemy.orm.Session.rollback", '{"owner":"{m}.run","operation":"rollback"}'),
        (1, "sqlalchemy.raw_sql", "sqlalchemy.text", '{"owner":"{m}.run","literal":false,"dynamic":false}'),
    ],
    "tortoise": [
        (0, "tortoise.models", "{m}.Cat", '{"name":"Cat"}'),
        (0, "tortoise.fields", "{m}.Cat.id", '{"owner":"{m}.Cat","kind":"tortoise.fields.IntField","arguments":[{"name":"pk","value":"True"}]}'),
        (0, "tortoise.relationships", "{m}.Cat.owner", '{"owner":"{m}.Cat","kind":"tortoise.fields.ForeignKeyField","arguments":[{"value":"\'x\'"}]}'),
        (0, "tortoise.queries", "{m}.Cat.filter", '{"owner":"{m}.go","is_write":false}'),
        (0, "tortoise.queries", "{m}.Cat.create", '{"owner":"{m}.go","is_write":true}'),
        (1, "tortoise.models", "{m}.Dog", '{"name":"Dog"}'),
        (1, "tortoise.connections", "tortoise.Tortoise.init", '{"owner":"{m}.go","operation":"init"}'),
        (1, "tortoise.transactions", "tortoise.transactions.in_transaction", '{"owner":"{m}.go","operation":"in_transaction"}'),
        (1, "tortoise.raw_sql", "{m}.Dog.raw", '{"owner":"{m}.go"}'),
    ],
}


def sql(framework: str) -> str:
    """What a framework's views show of a module for each supplier."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    cases = ", ".join(f"({n}, {text(view)}, {text(symbol)}, {text(own)})" for n, view, symbol, own in SHOWN[framework])
    filled = lambda c: f"replace({c}, '{{m}}', 'app.m' || s_suppkey) AS {c}"
    return f"WITH shown(n, shown_by, symbol, own) AS (VALUES {cases}) SELECT 'app.m' || s_suppkey AS module_id, shown_by, {filled('symbol')}, {filled('own')} FROM supplier JOIN shown ON s_suppkey % {len(SOURCES[framework])} = n"
