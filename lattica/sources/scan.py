"""Python source trees as tables."""

import io
import posixpath
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.names import glob_match, module_identity

# Directories that hold no owned source.
IGNORED = [
    ".bzr", ".direnv", ".eggs", ".git", ".git-rewrite", ".hg", ".ipynb_checkpoints", ".lattica_cache", ".mypy_cache", ".nox",
    ".pants.d", ".pyenv", ".pytest_cache", ".pytype", ".research", ".ruff_cache", ".svn", ".tox", ".venv", ".vscode",
    "__pycache__", "__pypackages__", "_build", "buck-out", "build", "dist", "node_modules", "site-packages", "venv",
]


def _empty_files(store, path) -> list[str]:
    """Python files without content, which Spark's readers leave out; only their names are listed."""
    found, files = [], store.listFiles(path, True)
    while files.hasNext():
        f = files.next()
        name = f.getPath().toString()
        if not f.getLen() and name.endswith((".py", ".pyi")):
            found.append(name)
    return found


def scan(spark: SparkSession, root: str, source_roots: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, force_include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, issues) of the .py and .pyi files below root, as place() gives them; source roots that lie outside of root or
    aren't there are issues too, and hold no sources."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{py,pyi}").load(root)
    base = files.select(F.col("path").alias("_full"), "content")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    base = base.union(spark.createDataFrame([(p, bytearray()) for p in _empty_files(store, at)], "_full string, content binary"))
    full = store.makeQualified(at).toString().rstrip("/")
    plain = re.sub("^file:/*", "/", full)
    t = base.withColumn("path", F.substr(F.regexp_replace("_full", "^file:/*", "/"), F.lit(len(plain) + 2))).drop("_full")
    usable, wrong = [], []
    for r in source_roots or ["."]:
        way = posixpath.normpath(r)
        if way.startswith(("/", "../")) or way == "..":
            wrong.append(("SOURCE_ROOT_OUTSIDE", r, "the source root lies outside of the project"))
        elif not store.exists(spark._jvm.org.apache.hadoop.fs.Path(root, way)):
            wrong.append(("SOURCE_ROOT_MISSING", r, "there is no such directory"))
        else:
            usable.append(way)
    sources, issues = place(t, usable, include, exclude, force_include)
    return sources, issues.union(spark.createDataFrame(wrong, "code string, path string, message string"))


def place(files: DataFrame, source_roots: list[str], include: list[str] | None = None, exclude: list[str] | None = None, force_include: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, issues) of files (path, relative and with slashes, and content, binary).

    sources: path, module_id, is_package, content, content_hash, line_count, status: analyzed, shadowed_stub or excluded.
    issues: code, path, message. A stub is shadowed by the source beside it; each file belongs to the longest source root
    that holds it, and files in none are left out; files that are no UTF-8, paths that differ in case only and modules of two
    files are issues."""
    roots = sorted({posixpath.normpath(r) for r in source_roots}, key=len, reverse=True)
    below = F.coalesce(F.lit(None).cast("string"), *[F.col("path") if r == "." else F.when(F.startswith("path", F.lit(f"{r}/")), F.substr("path", F.lit(len(r) + 2))) for r in roots])
    t = files.select("path", F.col("content").cast("string").alias("content"), below.alias("_below")).where("_below IS NOT NULL")
    forced = glob_match(F.col("path"), force_include or [])
    ignored = F.exists(F.split("path", "/"), lambda x: x.isin(*IGNORED))
    kept = glob_match(F.col("path"), include) if include else F.lit(True)
    t = t.withColumn("_out", ((ignored | glob_match(F.col("path"), exclude or [])) & ~forced) | ~(kept | forced))
    text = F.coalesce("content", F.lit(""))
    odd = ~F.col("_out") & ~F.is_valid_utf8(text)
    failed = t.where(odd).select(F.lit("SOURCE_READ_FAILURE").alias("code"), "path", F.lit("the file is no UTF-8").alias("message"))
    t = t.where(~odd)
    real = t.where("NOT _out AND endswith(path, '.py')").select(F.concat("path", F.lit("i")).alias("path"), F.lit(True).alias("_shadowed"))
    t = t.join(real, "path", "left")
    status = F.when(F.col("_out"), "excluded").when(F.col("_shadowed"), "shadowed_stub").otherwise("analyzed")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
    package = F.col("path").rlike(r"(^|/)__init__\.pyi?\z")
    sources = t.select(
        "path", module_identity(F.col("_below")).alias("module_id"), package.alias("is_package"), text.alias("content"),
        F.sha2(text.cast("binary"), 256).alias("content_hash"), lines.alias("line_count"), status.alias("status"),
    )
    live = sources.where("status = 'analyzed'")
    conflict = lambda key, code: live.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1").select(F.lit(code).alias("code"), "path", F.col("k").alias("message"))
    issues = conflict(F.lower("path"), "SOURCE_PATH_CONFLICT").union(conflict(F.col("module_id"), "SOURCE_MODULE_CONFLICT"))
    none = live.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("NO_SOURCES"), F.lit("."), F.lit("no Python file was found"))
    return sources, issues.union(none).union(failed)


DIRECTIVE = re.compile(r"#\s*lattica:\s*(.*)$")
IGNORE = re.compile(r"ignore\[([A-Z][A-Z0-9_]*[0-9]{3}(?:\s*,\s*[A-Z][A-Z0-9_]*[0-9]{3})*)\]$")


def inline_ignores(sources: DataFrame, rules: list[str], word: str = "lattica") -> DataFrame:
    """path, line (from 0), rule_id and issue of the comments "# <word>: ignore[RULE001, RULE002]". issue is null, or says
    that the comment is malformed or names an unknown rule. Comments are found by tokens, so strings hold none."""
    mark, known = re.compile(DIRECTIVE.pattern.replace("lattica", re.escape(word))), set(rules)
    schema = "path string, line int, rule_id string, issue string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    comments = [(x.start[0] - 1, x.string) for x in tokenize.generate_tokens(io.StringIO(content or "").readline) if x.type == tokenize.COMMENT]
                except (tokenize.TokenError, SyntaxError, IndentationError):
                    continue
                for line, text in comments:
                    if m := mark.search(text):
                        if not (found := IGNORE.match(m[1].strip())):
                            rows.append((path, line, None, "INVALID_INLINE_IGNORE"))
                            continue
                        for rule in re.split(r"\s*,\s*", found[1]):
                            rows.append((path, line, rule, None if rule in known else "UNKNOWN_INLINE_IGNORE_RULE"))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "line", "rule_id", "issue"])

    return sources.select("path", "content").mapInArrow(run, schema)
