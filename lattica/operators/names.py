"""Joins and matches on dotted names, paths and globs.

Prefix conditions become equi joins: the prefixes of a name are a short array, which is exploded, so both sides can be
hashed, and the longest match is an aggregate. A nested loop over names and prefixes never happens.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dotted_prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, longest first: a.b.c, a.b, a."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "."))


def prefix_join(left: DataFrame, name: str, right: DataFrame, prefix: str, how: str = "inner") -> DataFrame:
    """Each row of left with the row of right whose `prefix` is the longest dotted prefix of `name`; right's prefixes are
    distinct. how: inner, or left to keep rows without a match (right's columns are then null)."""
    tried = left.select(F.col(name).alias("_n")).distinct().select("_n", F.posexplode(dotted_prefixes(F.col("_n"))).alias("_rank", "_p"))
    known = right.select(F.struct(*right.columns).alias("_r"), F.col(prefix).alias("_p"))
    best = tried.join(known, "_p").groupBy("_n").agg(F.min_by("_r", "_rank").alias("_r"))
    rows = left.select(F.struct(*left.columns).alias("_l"), F.col(name).alias("_n"))
    return rows.join(best, "_n", "left" if how == "left" else "inner").select("_l.*", "_r.*")


def longest_prefix(left: DataFrame, key: str, name: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """key, matched prefix: of each distinct (key, name) the longest of prefixes that is a dotted prefix of name."""
    tried = left.select(key, F.posexplode(dotted_prefixes(F.col(name))).alias("_rank", "_p"))
    known = prefixes.select(F.col(prefix).alias("_p")).distinct()
    return tried.join(known, "_p").groupBy(key).agg(F.min_by("_p", "_rank").alias("matched"))


def canonicalize(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """names with the column canonical: the longest alias (columns alias, target) that is a dotted prefix of the name
    replaced by its target, once; a name without one is its own."""
    distinct = names.select(F.col(name).alias("_n")).distinct()
    tried = distinct.select("_n", F.posexplode(dotted_prefixes(F.col("_n"))).alias("_rank", "_p"))
    best = tried.join(aliases.select(F.col("alias").alias("_p"), "target"), "_p").groupBy("_n").agg(F.min_by(F.struct("_p", "target"), "_rank").alias("_b"))
    rewritten = F.concat(F.col("_b.target"), F.substr(F.col("_n"), F.length("_b._p") + 1))
    best = best.select(F.col("_n").alias(name), rewritten.alias("_c"))
    return names.join(best, name, "left").withColumn("canonical", F.coalesce("_c", name)).drop("_c")


def has_prefix(name: Column, prefix: Column) -> Column:
    """The name is the prefix or lies below it."""
    return (name == prefix) | F.startswith(name, F.concat(prefix, F.lit(".")))


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob in which * and ? also match a slash, [seq] is a set and [!seq] its complement."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else "\\^" + inner[1:] if inner[0] == "^" else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})\\z"


def glob_match(text: Column, patterns: list[str]) -> Column:
    """True where the text matches any of the globs."""
    if not patterns:
        return F.lit(False)
    return text.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))


def classify(paths: DataFrame, roles: list[dict], zones: list[dict], path: str = "path", default_zone: str = "prod") -> DataFrame:
    """paths with role (null if none), role_conflict, zone and zone_conflict.

    roles: name, include, exclude (globs) and priority; the highest priority wins, and a tie of two names is a conflict
    without a role. zones: name and patterns; two zones are a conflict, none is the default zone. Matchers are
    configuration, so they are part of the expression, and the plan stays one projection."""
    p = F.col(path)
    hits = [F.when(glob_match(p, r["include"]) & ~glob_match(p, r.get("exclude", [])), F.struct(F.lit(r.get("priority", 0)).alias("priority"), F.lit(r["name"]).alias("name"))) for r in roles]
    none = F.array().cast("array<struct<priority:int,name:string>>")
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else none
    in_zone = [F.when(glob_match(p, z["patterns"]), F.lit(z["name"])) for z in zones]
    zoned = F.filter(F.array(*in_zone), lambda x: x.isNotNull()) if in_zone else F.array().cast("array<string>")
    t = paths.withColumn("_m", matched).withColumn("_z", F.array_distinct(zoned))
    t = t.withColumn("_top", F.array_max(F.transform("_m", lambda x: x["priority"])))
    t = t.withColumn("_m", F.array_distinct(F.transform(F.filter("_m", lambda x: x["priority"] == F.col("_top")), lambda x: x["name"])))
    t = t.withColumn("role", F.when(F.size("_m") == 1, F.get("_m", F.lit(0)))).withColumn("role_conflict", F.size("_m") > 1)
    t = t.withColumn("zone", F.when(F.size("_z") == 1, F.get("_z", F.lit(0))).when(F.size("_z") == 0, F.lit(default_zone))).withColumn("zone_conflict", F.size("_z") > 1)
    return t.drop("_m", "_z", "_top")


def module_identity(path: Column) -> Column:
    """The dotted module of a source path below its root: suffix and __init__ dropped, parts that are no identifiers made
    readable, with 8 hex digits of their SHA-256."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.pyi?\z", ""), "/"), lambda x: x != "")
    parts = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == "__init__"), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    def part(x: Column) -> Column:
        plain = F.regexp_replace(x, r"[^\p{L}\p{N}_]", "_")
        plain = F.when(plain.rlike(r"^\p{N}"), F.concat(F.lit("_"), plain)).otherwise(plain)
        return F.when(x.rlike(r"^[\p{L}_][\p{L}\p{N}_]*\z"), x).otherwise(F.concat(plain, F.lit("_"), F.substring(F.sha2(x.cast("binary"), 256), 1, 8)))

    return F.array_join(F.transform(parts, part), ".")
