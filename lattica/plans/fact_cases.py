"""Modules whose facts are known: what each statement of three small modules, and of one that can't be read, must give.

The registered query writes a module for each row of a table, in the form that the row's number falls on.
"""

SOURCES = [
    "import os.path as p\nfrom . import sib\nfrom .pkg.deep import a as b\nif p:\n    import json\ndef f():\n    from time import sleep\n    sleep(1)\ntry:\n    import fast\nexcept ImportError:\n    fast = None\nfrom typing import TYPE_CHECKING\nif TYPE_CHECKING:\n    import late\n",
    "import functools\nclass A:\n    x: int = 1\n    @functools.cache\n    def m(self, y, *z, k=2, **w):\n        return y\n    async def n(self):\n        await self.m(1, k=3)\ng = lambda v: v\nclass B(A):\n    y = A()\nbox = A()\nbox.m(*[1], **{'k': 2})\n",
    "import json\nimport pickle\ndef f(c, s):\n    if c:\n        load = json.loads\n    else:\n        load = pickle.loads\n    load(s)\n    for x in s:\n        x.go()\n    unknown(s)\n    print(s)\n",
    "def f(:\n",
]

#: (form, line, column, kind, symbol, state, candidates, owner, guard, phase), lines and columns from 0; {m} is the module's name.
FACTS = [
    (0, 0, 0, "import", "os.path", "resolved", "", "{m}", "unconditional", "module_init"),
    (0, 1, 0, "import", "app.sib", "resolved", "", "{m}", "unconditional", "module_init"),
    (0, 2, 0, "import", "app.pkg.deep.a", "resolved", "", "{m}", "unconditional", "module_init"),
    (0, 4, 4, "import", "json", "resolved", "", "{m}", "conditional", "module_init"),
    (0, 5, 0, "function", "{m}.f", "resolved", "", "{m}", "unconditional", "module_init"),
    (0, 9, 4, "import", "fast", "resolved", "", "{m}", "conditional", "module_init"),
    (0, 11, 4, "field", "{m}.fast", None, "", "{m}", "conditional", "module_init"),
    (0, 12, 0, "import", "typing.TYPE_CHECKING", "resolved", "", "{m}", "unconditional", "module_init"),
    (0, 14, 4, "import", "late", "resolved", "", "{m}", "type_checking_only", "module_init"),
    (0, 6, 4, "import", "time.sleep", "resolved", "", "{m}.f", "unconditional", "deferred"),
    (0, 7, 4, "call", "time.sleep", "resolved", "", "{m}.f", "unconditional", "deferred"),
    (1, 0, 0, "import", "functools", "resolved", "", "{m}", "unconditional", "module_init"),
    (1, 1, 0, "class", "{m}.A", "resolved", "", "{m}", "unconditional", "module_init"),
    (1, 2, 4, "field", "{m}.A.x", None, "", "{m}.A", "unconditional", "module_init"),
    (1, 3, 5, "decorator", "functools.cache", "resolved", "", "{m}.A", "unconditional", "module_init"),
    (1, 4, 4, "function", "{m}.A.m", "resolved", "", "{m}.A", "unconditional", "module_init"),
    (1, 6, 4, "function", "{m}.A.n", "resolved", "", "{m}.A", "unconditional", "module_init"),
    (1, 8, 0, "field", "{m}.g", None, "", "{m}", "unconditional", "module_init"),
    (1, 9, 0, "class", "{m}.B", "resolved", "", "{m}", "unconditional", "module_init"),
    (1, 10, 8, "call", "{m}.A", "resolved", "", "{m}.B", "unconditional", "module_init"),
    (1, 10, 4, "field", "{m}.B.y", None, "", "{m}.B", "unconditional", "module_init"),
    (1, 11, 6, "call", "{m}.A", "resolved", "", "{m}", "unconditional", "module_init"),
    (1, 11, 0, "field", "{m}.box", None, "", "{m}", "unconditional", "module_init"),
    (1, 12, 0, "call", "{m}.A.m", "resolved", "", "{m}", "unconditional", "module_init"),
    (1, 7, 14, "call", "{m}.A.m", "resolved", "", "{m}.A.n", "unconditional", "deferred"),
    (2, 0, 0, "import", "json", "resolved", "", "{m}", "unconditional", "module_init"),
    (2, 1, 0, "import", "pickle", "resolved", "", "{m}", "unconditional", "module_init"),
    (2, 2, 0, "function", "{m}.f", "resolved", "", "{m}", "unconditional", "module_init"),
    (2, 7, 4, "call", "load", "ambiguous", "json.loads,pickle.loads", "{m}.f", "unconditional", "deferred"),
    (2, 9, 8, "call", "x.go", "dynamic", "", "{m}.f", "conditional", "deferred"),
    (2, 10, 4, "call", "unknown", "unresolved", "", "{m}.f", "unconditional", "deferred"),
    (2, 11, 4, "call", "builtins.print", "resolved", "", "{m}.f", "unconditional", "deferred"),
    (3, 0, 6, "failure", "PY_PARSE_001", None, "", None, None, None),
]


def sql() -> str:
    """The facts of a module for each supplier."""
    text = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    cases = ", ".join(f"({', '.join(map(text, f))})" for f in FACTS)
    m = "'app.m' || s_suppkey"
    return f"""WITH f(form, line, place, kind, symbol, state, candidates, owner, guard, phase) AS (VALUES {cases})
SELECT {m} AS module_id, line, place, kind, replace(symbol, '{{m}}', {m}) AS symbol, state, candidates, replace(owner, '{{m}}', {m}) AS owner, guard, phase FROM supplier JOIN f ON s_suppkey % {len(SOURCES)} = form"""


#: Comments and what they are: (text of a line, the rules it names, the issue it raises).
COMMENTS = [
    ("x = 1  # lattica: ignore[TIME001]", ["TIME001"], None),
    ("x = 1  # lattica: ignore[TIME001, SEC001]", ["TIME001", "SEC001"], None),
    ("x = '# lattica: ignore[TIME001]'", [], None),
    ("x = 1  # lattica: ignore TIME001", [None], "INVALID_INLINE_IGNORE"),
    ("x = 1  # lattica: ignore[NONE999]", ["NONE999"], "UNKNOWN_INLINE_IGNORE_RULE"),
    ("x = 1  # another comment", [], None),
]


def comments_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    cases = ", ".join(f"({n}, {text(rule)}, {text(issue)})" for n, (_, rules, issue) in enumerate(COMMENTS) for rule in rules)
    return f"WITH c(n, rule_id, issue) AS (VALUES {cases}) SELECT 'app/m' || s_suppkey || '.py' AS path, 1 AS line, rule_id, issue FROM supplier JOIN c ON s_suppkey % {len(COMMENTS)} = n"
