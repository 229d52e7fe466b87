"""Facts of Python sources: one pass over the syntax tree of each file, as rows of one long table.

Name resolution depends on the order of statements, so it stays in this pass; everything after it is relational. A file
that can't be parsed gives one row of kind failure, never an exception.
"""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

ITEM = "struct<name:string,position:int,symbol:string,literal:string,kind:string,text:string>"
FACT = (
    "module_id string, path string, kind string, n int, line int, column int, end_line int, end_column int, owner string, scope string, phase string, guard string, position string,"
    f" parent int, name string, symbol string, state string, candidates array<string>, attrs map<string,string>, items array<{ITEM}>"
)
NAMES = [part.strip().split(" ")[0] for part in FACT.split("items")[0].split(",") if part.strip()] + ["items"]

MAYBE = "?"
#: What a name may stand for: symbols; MAYBE among them says that on some path the name is not bound.
Meaning = frozenset


class Scope:
    def __init__(self, kind: str, symbol: str, outer: Scope | None):
        self.kind, self.symbol, self.outer = kind, symbol, outer
        self.names: dict[str, Meaning] = {}
        self.types: dict[str, str] = {}


class Facts(ast.NodeVisitor):
    """rows: the facts of a module, in the order of the visit."""

    def __init__(self, module: str, path: str, package: bool, tree: ast.Module):
        self.module, self.path, self.package = module, path, package
        self.rows: list[dict] = []
        self.scope = Scope("module", module, None)
        self.phase, self.guard, self.position = "module_init", "unconditional", "body"
        self.parent: int | None = None
        self.contexts: list[str] = []
        self.later: list = []
        for s in tree.body:
            self.visit(s)
        while self.later:  # bodies see the module as it is after its last statement
            work, self.later = self.later, []
            for run in work:
                run()

    # rows

    def add(self, kind: str, node: ast.AST, **values) -> dict:
        row = dict.fromkeys(NAMES) | {"module_id": self.module, "path": self.path, "kind": kind, "n": len(self.rows), "owner": self.scope.symbol, "scope": self.scope.kind, "phase": self.phase, "guard": self.guard, "position": self.position, "parent": self.parent}
        if hasattr(node, "lineno"):
            row |= {"line": node.lineno - 1, "column": node.col_offset, "end_line": node.end_lineno - 1, "end_column": node.end_col_offset}
        self.rows.append(row | values)
        return self.rows[-1]

    # names

    def bind(self, name: str, *meaning: str) -> None:
        self.scope.names[name] = Meaning(meaning)
        self.scope.types.pop(name, None)

    def lookup(self, name: str) -> tuple[Meaning | None, str | None]:
        scope: Scope | None = self.scope
        first = True
        while scope:
            if (first or scope.kind != "class") and name in scope.names:
                return scope.names[name], scope.types.get(name)
            first, scope = False, scope.outer
        return (Meaning([f"builtins.{name}"]), None) if hasattr(builtins, name) else (None, None)

    def ref(self, node: ast.AST) -> dict:
        """name, symbol, state and candidates of an expression that names something."""
        text = ast.unparse(node)
        tail: list[str] = []
        while isinstance(node, ast.Attribute):
            tail.insert(0, node.attr)
            node = node.value
        base: Meaning | None = None
        if isinstance(node, ast.Name):
            base, kind = self.lookup(node.id)
            if kind and tail:
                base = Meaning([kind])
        elif isinstance(node, ast.Call) and tail:
            made = self.ref(node.func)
            base = Meaning([made["symbol"]]) if made["symbol"] and made["symbol"].rpartition(".")[2][:1].isupper() else None
        if base is None:
            return {"name": text, "state": "unresolved" if isinstance(node, ast.Name) else "dynamic", "symbol": None, "candidates": []}
        found = sorted(".".join([b, *tail]) for b in base if b != MAYBE)
        if not found:
            return {"name": text, "state": "dynamic", "symbol": None, "candidates": []}
        if len(found) == 1 and MAYBE not in base:
            return {"name": text, "state": "resolved", "symbol": found[0], "candidates": []}
        return {"name": text, "state": "conditional" if len(found) == 1 else "ambiguous", "symbol": None, "candidates": found}

    def item(self, node: ast.AST, name: str | None = None, position: int | None = None) -> dict:
        literal = repr(node.value) if isinstance(node, ast.Constant) else None
        target = node.func if isinstance(node, ast.Call) else node
        symbol = self.ref(target)["symbol"] if isinstance(target, ast.Name | ast.Attribute) else None
        return {"name": name, "position": position, "symbol": symbol, "literal": literal, "kind": type(node).__name__, "text": ast.unparse(node)}

    # flow

    def branches(self, *bodies: list[ast.stmt], guard: str = "conditional") -> None:
        before, was = dict(self.scope.names), self.guard
        outcomes = []
        for body in bodies:
            self.scope.names = dict(before)
            self.guard = guard if was == "unconditional" else was
            for s in body:
                self.visit(s)
            outcomes.append(self.scope.names)
        self.guard = was
        merged: dict[str, Meaning] = {}
        for name in set().union(*outcomes):
            merged[name] = Meaning().union(*(o.get(name, Meaning([MAYBE])) for o in outcomes))
        self.scope.names = merged

    def visit_If(self, node: ast.If) -> None:
        self.visit(node.test)
        typing_only = isinstance(node.test, ast.Name | ast.Attribute) and self.ref(node.test)["symbol"] in ("typing.TYPE_CHECKING", "typing_extensions.TYPE_CHECKING")
        if typing_only:
            was, self.guard = self.guard, "type_checking_only"
            for s in node.body:
                self.visit(s)
            self.guard = was
            for s in node.orelse:
                self.visit(s)
        else:
            self.branches(node.body, node.orelse)

    def visit_Try(self, node: ast.Try) -> None:
        optional = any(h.type is not None and ast.unparse(h.type) in ("ImportError", "ModuleNotFoundError") or isinstance(h.type, ast.Tuple) and "ImportError" in ast.unparse(h.type) for h in node.handlers)
        was = getattr(self, "optional", False)
        self.optional = was or optional
        handlers = []
        for h in node.handlers:
            if h.type is not None:
                self.visit(h.type)
            handlers.append(h.body)
            if h.name:
                self.bind(h.name, MAYBE)
        self.branches([*node.body, *node.orelse], *handlers)
        self.optional = was
        for s in node.finalbody:
            self.visit(s)

    visit_TryStar = visit_Try

    def visit_For(self, node: ast.For | ast.AsyncFor) -> None:
        self.visit(node.iter)
        self.assign(node.target, None, "loop")
        self.branches(node.body, node.orelse)

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self.visit(node.test)
        self.branches(node.body, node.orelse)

    def visit_Match(self, node: ast.Match) -> None:
        self.visit(node.subject)
        for case in node.cases:
            for part in ast.walk(case.pattern):
                for name in (getattr(part, "name", None), getattr(part, "rest", None)):
                    if isinstance(name, str):
                        self.bind(name, MAYBE)
        self.branches(*(c.body for c in node.cases), [])

    # statements

    def imported(self, node: ast.Import | ast.ImportFrom, alias: ast.alias, base: str, level: int) -> None:
        is_from = isinstance(node, ast.ImportFrom)
        full = f"{base}.{alias.name}" if is_from and base else alias.name
        self.add("import", node, name=full, symbol=full, state="resolved", attrs={"module": base if is_from else alias.name, "imported": alias.name if is_from else "", "alias": alias.asname or "", "is_from": str(is_from).lower(), "level": str(level), "intent": "optional_dependency" if getattr(self, "optional", False) else "normal"})
        if alias.name == "*":
            return
        local = alias.asname or (alias.name if is_from else alias.name.split(".")[0])
        meant = full if is_from or alias.asname else local
        self.bind(local, meant)
        self.add("binding", node, name=local, symbol=meant, attrs={"binding": "import"})

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self.imported(node, alias, "", 0)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            parts = self.module.split(".")
            parts = parts[: len(parts) - node.level + self.package]
            base = ".".join([*parts, *([node.module] if node.module else [])])
        for alias in node.names:
            self.imported(node, alias, base, node.level)

    def decorators(self, node, symbol: str) -> list[str]:
        found = []
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            ref = self.ref(call.func if call else d)
            self.at("decorator", self.visit, d)
            items = [self.item(a, None, k) for k, a in enumerate(call.args)] + [self.item(k.value, k.arg) for k in call.keywords] if call else []
            self.add("decorator", d, attrs={"decorated": symbol, "unpack": str(bool(call) and any(k.arg is None for k in call.keywords)).lower()}, items=items, **ref)
            found.append(ref["symbol"] or ref["name"])
        return found

    def at(self, position: str, run, *args) -> None:
        was, self.position = self.position, position
        run(*args)
        self.position = was

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        symbol = f"{self.scope.symbol}.{node.name}"
        marks = self.decorators(node, symbol)
        a = node.args
        kinds = [("positional_only", x) for x in a.posonlyargs] + [("positional_or_keyword", x) for x in a.args] + ([("var_positional", a.vararg)] if a.vararg else []) + [("keyword_only", x) for x in a.kwonlyargs] + ([("var_keyword", a.kwarg)] if a.kwarg else [])
        places = [x for _, x in kinds if x in a.posonlyargs or x in a.args]
        optional = set(x.arg for x in places[len(places) - len(a.defaults) :]) | {x.arg for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is not None}
        items = []
        for n, (kind, x) in enumerate(kinds):
            ann = self.item(x.annotation) if x.annotation else {"symbol": None, "text": None}
            items.append({"name": x.arg, "position": n, "symbol": ann["symbol"], "literal": "default" if x.arg in optional else None, "kind": kind, "text": ann["text"]})
            if x.annotation:
                self.at("annotation", self.visit, x.annotation)
        for d in [*a.defaults, *(d for d in a.kw_defaults if d is not None)]:
            self.at("default", self.visit, d)
        if node.returns:
            self.at("annotation", self.visit, node.returns)
        returned = sorted({self.ref(r.value.func)["symbol"] or "" for r in ast.walk(node) if isinstance(r, ast.Return) and isinstance(r.value, ast.Call)} - {""})
        returns = self.item(node.returns) if node.returns else {"symbol": None, "text": None}
        self.add("function", node, name=node.name, symbol=symbol, state="resolved", candidates=returned, items=items, attrs={"is_async": str(isinstance(node, ast.AsyncFunctionDef)).lower(), "docstring": str(ast.get_docstring(node) is not None).lower(), "decorators": "\n".join(marks), "returns": returns["text"] or "", "returns_symbol": returns["symbol"] or ""})
        self.bind(node.name, symbol)
        self.add("binding", node, name=node.name, symbol=symbol, attrs={"binding": "definition"})
        outer, contexts = self.scope, self.contexts

        def body() -> None:
            was = self.scope, self.phase, self.contexts, self.guard
            self.scope, self.phase, self.contexts, self.guard = Scope("function", symbol, outer), "deferred", [], "unconditional"
            for x, item in zip((x for _, x in kinds), items):
                self.scope.names[x.arg] = Meaning([f"{symbol}.{x.arg}"])
                if item["symbol"]:
                    self.scope.types[x.arg] = item["symbol"]
                self.add("binding", x, name=x.arg, attrs={"binding": "parameter"})
            if outer.kind == "class" and kinds:
                self.scope.types[kinds[0][1].arg] = outer.symbol
            for s in node.body:
                self.visit(s)
            self.scope, self.phase, self.contexts, self.guard = was

        del contexts
        self.later.append(body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        outer = self.scope
        symbol = f"{outer.symbol}.<lambda:{node.lineno}:{node.col_offset}>"

        def body() -> None:
            was = self.scope, self.phase
            self.scope, self.phase = Scope("lambda", symbol, outer), "deferred"
            for x in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                self.scope.names[x.arg] = Meaning([MAYBE])
            self.visit(node.body)
            self.scope, self.phase = was

        self.later.append(body)

    def comprehension(self, node) -> None:
        was = self.scope
        self.scope = Scope("comprehension", was.symbol, was)
        for g in node.generators:
            self.visit(g.iter)
            self.assign(g.target, None, "comprehension")
            for test in g.ifs:
                self.visit(test)
        for part in ("key", "value", "elt"):
            if hasattr(node, part):
                self.visit(getattr(node, part))
        self.scope = was

    visit_ListComp = visit_SetComp = visit_GeneratorExp = visit_DictComp = comprehension

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        symbol = f"{self.scope.symbol}.{node.name}"
        marks = self.decorators(node, symbol)
        items = [self.item(b, None, k) for k, b in enumerate(node.bases)] + [self.item(k.value, k.arg) for k in node.keywords]
        for b in node.bases:
            self.at("base", self.visit, b)
        self.add("class", node, name=node.name, symbol=symbol, state="resolved", items=items, attrs={"docstring": str(ast.get_docstring(node) is not None).lower(), "decorators": "\n".join(marks)})
        self.bind(node.name, symbol)
        self.add("binding", node, name=node.name, symbol=symbol, attrs={"binding": "definition"})
        was = self.scope
        self.scope = Scope("class", symbol, was)
        for s in node.body:
            self.visit(s)
        self.scope = was

    def assign(self, target: ast.AST, value: ast.AST | None, kind: str = "assignment", annotation: ast.AST | None = None) -> None:
        if isinstance(target, ast.Tuple | ast.List):
            for x in target.elts:
                self.assign(x, None, kind)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, None, kind)
        elif isinstance(target, ast.Name):
            own = f"{self.scope.symbol}.{target.id}"
            alias = self.ref(value) if isinstance(value, ast.Name | ast.Attribute) else None
            inner = value.value if isinstance(value, ast.Await) else value
            made = self.ref(inner.func)["symbol"] if isinstance(inner, ast.Call) else None
            if alias and alias["symbol"] and kind == "assignment":
                self.bind(target.id, alias["symbol"])
            else:
                self.bind(target.id, own if self.scope.kind in ("module", "class") else MAYBE)
            if made:
                self.scope.types[target.id] = made
            self.add("binding", target, name=target.id, symbol=own, attrs={"binding": kind})
            if self.scope.kind in ("module", "class") and kind == "assignment":
                said = self.item(annotation) if annotation else {"symbol": None, "text": ""}
                shown = self.item(value) if value is not None else {"symbol": None, "literal": None, "text": "", "kind": ""}
                items = [self.item(a, None, k) for k, a in enumerate(inner.args)] + [self.item(k.value, k.arg) for k in inner.keywords] if isinstance(inner, ast.Call) else []
                self.add("field", target, name=target.id, symbol=own, items=items, attrs={"annotated": str(annotation is not None).lower(), "annotation": said["text"] or "", "annotation_symbol": said["symbol"] or "", "value": shown["text"] or "", "value_symbol": shown["symbol"] or "", "value_kind": shown["kind"] or "", "literal": shown["literal"] or ""})
        elif isinstance(target, ast.Attribute | ast.Subscript):
            self.visit(target.value)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for x in node.targets:
            self.assign(x, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.at("annotation", self.visit, node.annotation)
        if node.value:
            self.visit(node.value)
        self.assign(node.target, node.value, "assignment", node.annotation)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.visit(node.value)
        self.assign(node.target, node.value, "walrus")

    def visit_With(self, node: ast.With | ast.AsyncWith) -> None:
        entered = []
        for w in node.items:
            self.at("context_manager", self.visit, w.context_expr)
            target = w.context_expr.func if isinstance(w.context_expr, ast.Call) else w.context_expr
            entered.append(self.ref(target)["symbol"] or "")
            self.contexts = [*self.contexts, entered[-1]]
            if w.optional_vars:
                self.assign(w.optional_vars, w.context_expr, "with_item")
        for s in node.body:
            self.visit(s)
        self.contexts = self.contexts[: len(self.contexts) - len(entered)]

    visit_AsyncWith = visit_With

    # expressions

    def visit_Call(self, node: ast.Call) -> None:
        ref = self.ref(node.func)
        items = [self.item(a, None, k) for k, a in enumerate(node.args)] + [self.item(k.value, k.arg) for k in node.keywords]
        row = self.add("call", node, items=items, attrs={"keywords": ",".join(sorted(k.arg for k in node.keywords if k.arg)), "unpack": str(any(k.arg is None for k in node.keywords)).lower(), "contexts": "\n".join(x for x in self.contexts if x)}, **ref)
        was, self.parent = self.parent, row["n"]
        self.visit(node.func)
        for a in [*node.args, *(k.value for k in node.keywords)]:
            self.at("argument", self.visit, a)
        self.parent = was

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("reference", node, **self.ref(node))

    def visit_Attribute(self, node: ast.Attribute) -> None:
        if isinstance(node.ctx, ast.Load):
            self.add("reference", node, **self.ref(node))
        inner = node.value
        while isinstance(inner, ast.Attribute):
            inner = inner.value
        if not isinstance(inner, ast.Name):
            self.visit(inner)


def module_facts(module: str, path: str, package: bool, content: str) -> list[dict]:
    """The rows of a file; one failure row if it can't be read."""
    empty = dict.fromkeys(NAMES) | {"module_id": module, "path": path, "kind": "failure", "n": 0, "candidates": [], "attrs": {}, "items": []}
    try:
        return Facts(module, path, package, ast.parse(content)).rows
    except SyntaxError as e:
        return [empty | {"name": "PY_PARSE_001", "line": (e.lineno or 1) - 1, "column": max((e.offset or 1) - 1, 0), "attrs": {"message": str(e.msg)}}]
    except Exception as e:  # one odd file is an issue of the report, not the end of the run
        return [empty | {"name": "PY_ANALYSIS_001", "line": 0, "column": 0, "attrs": {"message": f"{type(e).__name__}: {e}"}}]


def extract(sources: DataFrame) -> DataFrame:
    """All facts of sources (module_id, path, is_package, content), as one table of kinds import, binding, function, class,
    field, decorator, call, reference and failure."""
    schema: StructType = _parse_datatype_string(FACT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for module, path, package, content in zip(*(c.to_pylist() for c in b.columns)):
                rows = module_facts(module, path, bool(package), content or "")
                for at in range(0, len(rows), 5000):
                    part = [r | {"attrs": list((r["attrs"] or {}).items()), "candidates": r["candidates"] or [], "items": r["items"] or []} for r in rows[at : at + 5000]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in part], f.type) for f in arrow], schema=arrow)

    return sources.select("module_id", "path", "is_package", "content").mapInArrow(run, schema)
