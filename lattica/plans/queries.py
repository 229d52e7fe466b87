"""The engine's operators applied to whole tables, each with the same query in DuckDB's SQL.

Facts are read out of the tables: parts are symbols with dotted names, orders and line items are edges between nations,
events are calls with states. The registered queries read the columns they need and nothing is limited or sampled.
"""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fingerprints
from ..operators import aggregates, graph, joins, names
from ..storage import written
from . import fact_cases, rule_cases, view_cases

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SYMBOL = "replace(p_name, ' ', '.') || '.' || lower(p_type) || '.n' || p_partkey"
TRADE = """trade AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n, sum(l_quantity) AS q FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
#: Edges of a sparse directed graph over parts: part k leads to part (31 k + size) mod the number of parts.
PART_EDGES = "e AS (SELECT p_partkey AS src, (p_partkey * 31 + p_size) % (SELECT count(*) FROM part) AS dst FROM part)"


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), F.lower("p_type"), F.lit(".n"), F.col("p_partkey").cast("string")).alias("symbol"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from a supplier's nation to a customer's, with the number of line items."""
    items = t(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey").join(t(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))


def part_edges(spark: SparkSession, sf: str) -> DataFrame:
    part = t(spark, sf, "part").select("p_partkey", "p_size")
    total = part.count()
    return part.select(F.col("p_partkey").alias("src"), F.pmod(F.col("p_partkey") * 31 + F.col("p_size"), F.lit(total)).alias("dst"))


@query(f"""WITH {TRADE}, r AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT a.r_name AS source_role, b.r_name AS target_role, CASE WHEN a.r_name = b.r_name OR a.r_name = 'ASIA' OR b.r_name = 'EUROPE' THEN 'pass' ELSE 'fail' END AS verdict,
sum(n)::BIGINT AS edges FROM trade JOIN r a ON a.n_nationkey = src JOIN r b ON b.n_nationkey = dst GROUP BY ALL""")
def import_direction(spark: SparkSession, sf: str) -> DataFrame:
    """Edges against an allow graph of roles: a verdict for each pair of roles."""
    role = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    regions = t(spark, sf, "region").select("r_name")
    pairs = regions.select(F.col("r_name").alias("source_role")).join(regions.select(F.col("r_name").alias("target_role")), F.expr("source_role = target_role OR source_role = 'ASIA' OR target_role = 'EUROPE'"))
    edges = trade(spark, sf).join(role.select(F.col("n_nationkey").alias("src"), F.col("r_name").alias("source_role")), "src").join(role.select(F.col("n_nationkey").alias("dst"), F.col("r_name").alias("target_role")), "dst")
    judged = edges.join(pairs.withColumn("ok", F.lit(True)), ["source_role", "target_role"], "left")
    return judged.groupBy("source_role", "target_role", F.when(F.col("ok"), "pass").otherwise("fail").alias("verdict")).agg(F.sum("n").alias("edges"))


@query(f"""WITH s AS (SELECT p_partkey, {SYMBOL} AS symbol FROM part),
p AS (SELECT DISTINCT replace(p_name, ' ', '.') AS prefix FROM part UNION SELECT DISTINCT replace(p_name, ' ', '.') || '.' || lower(p_type) FROM part WHERE p_type IN ('PROMO', 'LARGE'))
SELECT p_partkey, symbol, arg_max(prefix, length(prefix)) AS prefix FROM s JOIN p ON symbol = prefix OR starts_with(symbol, prefix || '.') GROUP BY ALL""")
def prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    """Longest dotted prefix: each symbol with its module."""
    part = t(spark, sf, "part")
    plain = F.replace("p_name", F.lit(" "), F.lit("."))
    modules = part.select(plain.alias("prefix")).union(part.where("p_type IN ('PROMO', 'LARGE')").select(F.concat(plain, F.lit("."), F.lower("p_type")))).distinct()
    return names.prefix_join(symbols(spark, sf).drop("p_size"), "symbol", modules, "prefix")


@query(f"""WITH s AS (SELECT p_partkey, {SYMBOL} AS symbol FROM part),
a AS (SELECT DISTINCT replace(p_name, ' ', '.') AS alias, 'core.' || split_part(p_name, ' ', 2) AS target FROM part WHERE p_name LIKE 'small%' UNION SELECT DISTINCT split_part(p_name, ' ', 1), 'lib.' || split_part(p_name, ' ', 1) FROM part WHERE p_name LIKE 's%'),
m AS (SELECT p_partkey, arg_max(alias, length(alias)) AS alias, arg_max(target, length(alias)) AS target FROM s JOIN a ON symbol = alias OR starts_with(symbol, alias || '.') GROUP BY ALL)
SELECT s.p_partkey, s.symbol, coalesce(target || substr(symbol, length(alias) + 1), symbol) AS canonical FROM s LEFT JOIN m USING (p_partkey)""")
def canonical_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Longest alias rewritten once."""
    part = t(spark, sf, "part")
    second, first = F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))
    aliases = part.where("p_name LIKE 'small%'").select(F.replace("p_name", F.lit(" "), F.lit(".")).alias("alias"), F.concat(F.lit("core."), second).alias("target"))
    aliases = aliases.union(part.where("p_name LIKE 's%'").select(first, F.concat(F.lit("lib."), first))).distinct()
    return names.canonicalize(symbols(spark, sf).drop("p_size"), "symbol", aliases)


ROLES = [{"name": "english", "include": ["*/en/*"], "exclude": ["*page=[1-3]*"], "priority": 1}, {"name": "mobile", "include": ["*//m.*"], "priority": 2}, {"name": "org", "include": ["*.org/*"], "priority": 1}]
ZONES = [{"name": "test", "patterns": ["*#top", "*?page=?&*"]}, {"name": "script", "patterns": ["http://*"]}]


@query("""WITH c AS (SELECT page_id, url, url GLOB '*/en/*' AND NOT url GLOB '*page=[1-3]*' AS a, url GLOB '*//m.*' AS b, url GLOB '*.org/*' AS o, url GLOB '*#top' OR url GLOB '*[?]page=?&*' OR url GLOB '*?page=?&*' AS x, url GLOB 'http://*' AS y FROM pages)
SELECT page_id, CASE WHEN b THEN 'mobile' WHEN a AND o THEN NULL WHEN a THEN 'english' WHEN o THEN 'org' END AS role, NOT b AND a AND o AS role_conflict,
CASE WHEN x AND y THEN NULL WHEN x THEN 'test' WHEN y THEN 'script' ELSE 'prod' END AS zone, x AND y AS zone_conflict FROM c""")
def classification(spark: SparkSession, sf: str) -> DataFrame:
    """Roles by priority with ties as conflicts, zones with a default."""
    return names.classify(t(spark, sf, "pages").select("page_id", "url"), ROLES, ZONES, path="url").drop("url")


@query("""WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://', '') || '/mod.py' AS path FROM pages),
l AS (SELECT page_id, path, list_filter(string_split(regexp_replace(path, '\\.pyi?$', ''), '/'), lambda x: x <> '') AS parts FROM p)
SELECT page_id, path, array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z_][A-Za-z0-9_]*$') THEN x ELSE CASE WHEN regexp_matches(x, '^[0-9]') THEN '_' ELSE '' END || regexp_replace(x, '[^A-Za-z0-9_]', '_', 'g') || '_' || substr(sha256(x), 1, 8) END), '.') AS module_id FROM l""")
def module_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted module names of paths, odd parts made readable and unique."""
    path = F.concat(F.regexp_replace(F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)), "^https?://", ""), F.lit("/mod.py"))
    return t(spark, sf, "pages").select("page_id", path.alias("path")).withColumn("module_id", names.module_identity(F.col("path")))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS s FROM orders),
i AS (SELECT o_custkey AS k, l_orderkey, l_linenumber, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderkey, count(*)::BIGINT AS held, min(l_orderkey)::BIGINT AS first FROM o JOIN i ON o.k = i.k AND i.s >= o.s AND i.s + 10 <= o.s + 90 GROUP BY o_orderkey""")
def containment(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges in ranges: shipments within 90 days of any order of the same customer."""
    day = lambda c: F.datediff(F.col(c), F.lit("1990-01-01").cast("date"))
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", day("o_orderdate").alias("start")).withColumn("end", F.col("start") + 90)
    i = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("k"), "l_orderkey", day("l_shipdate").alias("start")).withColumn("end", F.col("start") + 10)
    return joins.containment_join(o, i, ["k"]).groupBy("o_orderkey").agg(F.count("*").alias("held"), F.min("inner_l_orderkey").alias("first"))


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT p.event_id, p.user_id, coalesce(v.view_id, -1) AS view_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def nearest_binding(spark: SparkSession, sf: str) -> DataFrame:
    """As-of join: each purchase with the user's last view before it."""
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.nearest_left(e.where("event_type = 'purchase'").drop("event_type"), views, ["user_id"], "ts", "view_id").select("event_id", "user_id", F.coalesce("view_id", F.lit(-1)).alias("view_id"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def change_set(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of the orders, made from the table by rule, and what changed between them."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    before = o.where("k % 7 <> 0").select("k", F.col("o_orderstatus").alias("v"))
    after = o.where("k % 5 <> 0").select("k", F.when(F.col("o_orderpriority") == "1-URGENT", "U").otherwise(F.col("o_orderstatus")).alias("v"))
    return joins.snapshot_diff(before, after, "k", "v")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'), i AS (SELECT p_partkey, min(p_brand) AS r FROM part WHERE p_size > 40 GROUP BY ALL), a AS (SELECT s_suppkey, min(s_name) AS r FROM supplier WHERE s_acctbal < 2000 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN i.r IS NOT NULL THEN 0 WHEN a.r IS NOT NULL THEN 1 ELSE -1 END AS source, coalesce(i.r, a.r) AS reason FROM f LEFT JOIN i ON l_partkey = p_partkey LEFT JOIN a ON l_suppkey = s_suppkey""")
def suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with the first table that suppresses them."""
    f = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ignores = t(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("why"))
    approvals = t(spark, sf, "supplier").where("s_acctbal < 2000").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("why"))
    return joins.precedence_lookup(f, (ignores, ["l_partkey"], "why"), (approvals, ["l_suppkey"], "why")).withColumn("source", F.coalesce("source", F.lit(-1)))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def unused_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that no returned line item uses."""
    used = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched(t(spark, sf, "orders").select("o_orderkey", "o_custkey"), used, ["o_orderkey"])


@query(f"""WITH RECURSIVE {PART_EDGES}, r AS (SELECT p_partkey AS node FROM part WHERE p_size = 1 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def reachable(spark: SparkSession, sf: str) -> DataFrame:
    """All parts that those of size 1 lead to."""
    return graph.reachable(part_edges(spark, sf), t(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")))


@query(f"""WITH RECURSIVE {TRADE}, e AS (SELECT src, dst FROM trade), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c""")
def import_closure(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of nations joined by a path of trade edges."""
    return graph.closure(trade(spark, sf).select("src", "dst"))


@query(f"""WITH RECURSIVE {PART_EDGES}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM c JOIN e ON b = src), k AS (SELECT DISTINCT a AS node FROM c WHERE a = b)
SELECT k.node, min(c.b) AS component FROM k JOIN c ON c.a = k.node JOIN c d ON d.a = c.b AND d.b = k.node GROUP BY k.node""")
def import_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Strongly connected components of the graph over parts that have a cycle."""
    return graph.scc(part_edges(spark, sf))


@query(f"""WITH RECURSIVE {PART_EDGES}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT a, dst FROM c JOIN e ON b = src), k AS (SELECT DISTINCT a AS node FROM c WHERE a = b),
m AS (SELECT DISTINCT min(c.b) AS component FROM k JOIN c ON c.a = k.node JOIN c d ON d.a = c.b AND d.b = k.node GROUP BY k.node),
w AS (SELECT component, dst AS node, component || '>' || dst AS path FROM m JOIN e ON src = component UNION ALL SELECT component, e.dst, path || '>' || e.dst FROM w JOIN e ON e.src = node WHERE node <> component)
SELECT component, path FROM w WHERE node = component""")
def cycle_witnesses(spark: SparkSession, sf: str) -> DataFrame:
    """A shortest cycle for each component, through its smallest node."""
    edges = part_edges(spark, sf)
    return graph.cycle_witness(edges, graph.scc(edges)).select("component", F.array_join("path", ">").alias("path"))


@query(f"""WITH RECURSIVE {PART_EDGES}, a AS (SELECT src AS alias, dst AS target FROM e WHERE src > dst), r AS (SELECT alias, target FROM a UNION ALL SELECT r.alias, a.target FROM r JOIN a ON r.target = a.alias) SELECT alias, target FROM r WHERE target NOT IN (SELECT alias FROM a)""")
def alias_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of aliases to the name that is none."""
    return graph.alias_chase(part_edges(spark, sf).where("src > dst").select(F.col("src").alias("alias"), F.col("dst").alias("target")))


@query(f"""WITH RECURSIVE {PART_EDGES}, b AS (SELECT p_partkey AS node, p_brand AS value FROM part WHERE p_size > 48), r AS (SELECT node, value FROM b UNION SELECT e.src, r.value FROM r JOIN e ON e.dst = r.node) SELECT node, value FROM r""")
def fixture_approvals(spark: SparkSession, sf: str) -> DataFrame:
    """Sets handed up along edges until nothing is new."""
    base = t(spark, sf, "part").where("p_size > 48").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("value"))
    return graph.set_fixpoint(base, part_edges(spark, sf))


@query(f"""WITH RECURSIVE {PART_EDGES}, b AS (SELECT p_partkey AS node, (1::BIGINT << (p_size % 8)) AS mask FROM part WHERE p_size < 8), r AS (SELECT node, mask FROM b UNION SELECT e.src, r.mask FROM r JOIN e ON e.dst = r.node)
SELECT p_partkey AS node, coalesce(bit_or(mask), 0)::BIGINT AS mask FROM part LEFT JOIN r ON r.node = p_partkey GROUP BY p_partkey""")
def effect_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Effects as bit masks, joined over all that a node leads to."""
    part = t(spark, sf, "part")
    base = part.where("p_size < 8").select(F.col("p_partkey").alias("node"), F.expr("shiftleft(1L, p_size % 8)").alias("mask"))
    # each part, those without edges too, and no ends of edges that are no parts
    masks = graph.mask_fixpoint(base, part_edges(spark, sf))
    return part.select(F.col("p_partkey").alias("node")).distinct().join(masks, "node", "left").select("node", F.coalesce("mask", F.lit(0).cast("long")).alias("mask"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS w FROM orders), c AS (SELECT c_custkey, c_nationkey, least(coalesce(sum(w), 0), 2) AS w FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey, least(coalesce(sum(w), 0), 2) AS w FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT 'o' || o_orderkey AS node, w::INTEGER AS lower, w::INTEGER AS upper FROM o UNION ALL SELECT 'c' || c_custkey, w::INTEGER, w::INTEGER FROM c UNION ALL SELECT 'n' || n_nationkey, w::INTEGER, w::INTEGER FROM n""")
def write_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that saturate at two, summed up a call graph of nations, customers and orders."""
    name = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    o, c, n = t(spark, sf, "orders"), t(spark, sf, "customer"), t(spark, sf, "nation")
    w = F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    base = o.select(name("o", "o_orderkey").alias("node"), w.alias("lower"), w.alias("upper"))
    zero = F.lit(0)
    base = base.union(c.select(name("c", "c_custkey"), zero, zero)).union(n.select(name("n", "n_nationkey"), zero, zero))
    known = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    edges = known.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return graph.saturating_fixpoint(base, edges)


@query(f"""WITH RECURSIVE {PART_EDGES}, both_ AS (SELECT src, dst FROM e UNION ALL SELECT src, (dst + 1) % (SELECT count(*) FROM part) FROM e WHERE src % 3 = 0), r AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#7' UNION SELECT src FROM r JOIN both_ ON dst = node) SELECT node FROM r""")
def change_impact(spark: SparkSession, sf: str) -> DataFrame:
    """What depends on changed nodes by the old or the new edges."""
    part = t(spark, sf, "part")
    before, total = part_edges(spark, sf), part.count()
    after = before.where("src % 3 = 0").select("src", F.pmod(F.col("dst") + 1, F.lit(total)).alias("dst"))
    return graph.impact(part.where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("node")), before, after)


EVALUATED = "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'not_applicable' ELSE 'indeterminate' END"
STATED = "CASE event_type WHEN 'view' THEN 'resolved' WHEN 'click' THEN 'conditional' WHEN 'error' THEN 'unresolved' WHEN 'signup' THEN 'ambiguous' ELSE 'dynamic' END"


def _counts(values: tuple[str, ...]) -> str:
    return ", ".join(f"count(*) FILTER (v = '{x}')::BIGINT AS {x}" for x in values)


@query(f"SELECT user_id, {_counts(aggregates.VERDICTS)}, count(*)::BIGINT AS total FROM (SELECT user_id, {EVALUATED} AS v FROM events) GROUP BY user_id")
def rule_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts counted by rule."""
    return aggregates.verdict_counts(t(spark, sf, "events").select("user_id", F.expr(EVALUATED).alias("verdict")), ["user_id"])


@query(f"SELECT {_counts(aggregates.STATES)} FROM (SELECT {STATED} AS v FROM events)")
def resolution_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """States of resolution counted."""
    return aggregates.resolution_coverage(t(spark, sf, "events").select(F.expr(STATED).alias("state")))


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY ALL HAVING count(*) > 1)")
def duplicate_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key is used more than once."""
    return aggregates.duplicates(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each key in a declared order."""
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("_rank"))
    return aggregates.first_of(o, ["o_custkey"], ["_rank", "o_orderkey"]).drop("_rank")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_writer(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of each key."""
    return aggregates.last_of(t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("SELECT source, least(greatest(ceil(percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) * 1.2 / 50) * 50, 200), 700)::BIGINT AS max_lines FROM (SELECT source, n_chars // 20 AS n_chars FROM documents) GROUP BY source")
def size_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Size limits from the 95th percentile."""
    return aggregates.size_limits(t(spark, sf, "documents").select("source", F.expr("n_chars div 20").alias("n_chars")), ["source"], "n_chars")


@query("SELECT l_orderkey, least(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 2)::BIGINT AS writes FROM lineitem GROUP BY l_orderkey")
def saturating_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that stop at two."""
    items = t(spark, sf, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("w"))
    return items.groupBy("l_orderkey").agg(aggregates.saturating_sum("w").alias("writes"))


@query("WITH x AS (SELECT l_orderkey, l_linenumber, unnest([l_returnflag, l_linestatus]) AS key FROM lineitem), n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM x GROUP BY ALL) SELECT x.l_orderkey, key FROM x JOIN n USING (l_orderkey) GROUP BY x.l_orderkey, key, n HAVING count(DISTINCT l_linenumber) = n")
def common_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Flags that all line items of an order have."""
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array("l_returnflag", "l_linestatus")).alias("key"))
    return aggregates.common_members(x, ["l_orderkey"], "l_linenumber", "key")


@query("SELECT l_suppkey, bit_or(1::BIGINT << (l_linenumber % 8)) AS effects, bit_or(CASE WHEN l_discount > 0.05 THEN 1::BIGINT << (l_linenumber % 8) ELSE 0 END) AS direct FROM lineitem GROUP BY l_suppkey")
def merged_effects(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of effects, direct ones apart, joined by key."""
    bit = F.expr("shiftleft(1L, l_linenumber % 8)")
    rows = t(spark, sf, "lineitem").select("l_suppkey", bit.alias("effects"), F.when(F.col("l_discount") > 0.05, bit).otherwise(F.lit(0).cast("long")).alias("direct"))
    return aggregates.merge_effects(rows, ["l_suppkey"])


@query(f"SELECT CASE WHEN count(*) FILTER ({EVALUATED} = 'indeterminate' AND user_id % 2 = 0) > 0 THEN 2 WHEN count(*) FILTER ({EVALUATED} = 'fail' AND user_id % 2 = 0 AND value > 0) > 0 THEN 1 ELSE 0 END::INTEGER AS exit_code FROM events")
def exit_decision(spark: SparkSession, sf: str) -> DataFrame:
    """The exit code of a run."""
    e = t(spark, sf, "events")
    f = e.select(F.expr(EVALUATED).alias("verdict"), F.when(F.col("user_id") % 2 == 0, "enforced").otherwise("advisory").alias("level"), F.when(F.col("value") > 0, "active").otherwise("ignored").alias("disposition"))
    return aggregates.exit_code(f, e.where("event_type IS NULL"))


@query("""WITH c AS (SELECT toxic = 1 AS v, CASE WHEN quality = 0 THEN 'violation' ELSE 'no_finding' END AS o FROM labels),
k AS (SELECT count(*) FILTER (o = 'violation' AND v)::BIGINT AS tp, count(*) FILTER (o = 'violation' AND NOT v)::BIGINT AS fp, count(*) FILTER (o <> 'violation' AND v)::BIGINT AS fn, count(*) FILTER (o <> 'violation' AND NOT v)::BIGINT AS tn FROM c)
SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM k""")
def detection_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Precision and recall over labelled cases."""
    return aggregates.confusion(t(spark, sf, "labels").select((F.col("toxic") == 1).alias("violation"), F.when(F.col("quality") == 0, "violation").otherwise("no_finding").alias("observed")))


@query("""WITH e AS (SELECT event_id AS id, epoch_us(ts) // 1000000 AS accessed, (value * 100)::BIGINT AS bytes FROM events), m AS (SELECT max(accessed) AS now FROM e), y AS (SELECT e.*, sum(bytes) OVER (ORDER BY accessed DESC, id DESC) AS upto FROM e, m WHERE accessed >= now - 20 * 86400)
SELECT id, bytes, accessed FROM e, m WHERE accessed < now - 20 * 86400 UNION ALL SELECT id, bytes, accessed FROM y WHERE upto > 10000000""")
def cache_eviction(spark: SparkSession, sf: str) -> DataFrame:
    """Old entries, then the least recently used ones beyond the capacity."""
    e = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.round(F.col("value") * 100).cast("long").alias("bytes"), F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("accessed"))
    now = e.agg(F.max("accessed")).first()[0]
    return aggregates.evict(e, F.lit(now), 20 * 86400, 10_000_000, slices=3600)


@query("""SELECT event_id, sha256(user_id::VARCHAR || chr(0) || coalesce(props, '') || chr(0) || event_type || chr(0) || 's' || chr(0) || row_number() OVER (PARTITION BY user_id, props, event_type ORDER BY event_id)::VARCHAR) AS fact_id FROM events""")
def fact_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Stable ids of facts."""
    e = t(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("module_id"), F.coalesce("props", F.lit("")).alias("scope"), F.col("event_type").alias("kind"), F.lit("s").alias("subject"))
    return fingerprints.fact_ids(e, ["event_id"]).select("event_id", "fact_id")


@query("""SELECT c.conv_id, c.turn, c.role, p.role AS before FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1 WHERE c.role = p.role OR p.role = 'system'""")
def parent_child(spark: SparkSession, sf: str) -> DataFrame:
    """Facts joined with their parent: turns that repeat a role or open a conversation."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before"))
    return c.join(p, ["conv_id", "turn"]).where("role = before OR before = 'system'")


@query("""SELECT o_orderkey, coalesce(bool_and(l_returnflag = 'R'), false) AS all_returned, coalesce(bool_or(l_returnflag = 'R'), false) AS any_returned FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def all_and_any(spark: SparkSession, sf: str) -> DataFrame:
    """Conditions that hold for all or any members of a group; an empty group has neither."""
    flags = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_and(F.col("l_returnflag") == "R").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("b"))
    none = F.lit(False)
    return t(spark, sf, "orders").select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", none).alias("all_returned"), F.coalesce("b", none).alias("any_returned"))


@query("""WITH g AS (SELECT 'inner' AS grp, n_nationkey AS member FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'outer', n_nationkey FROM nation WHERE n_regionkey >= 2),
a AS (SELECT n_nationkey AS role, unnest([CASE WHEN n_nationkey % 2 = 0 THEN '@inner' ELSE '@outer' END, n_nationkey::VARCHAR]) AS allowed FROM nation)
SELECT DISTINCT role, coalesce(member, try_cast(allowed AS INTEGER))::INTEGER AS target FROM a LEFT JOIN g ON allowed = '@' || grp""")
def role_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Allow lists with groups of roles, expanded once."""
    n = t(spark, sf, "nation")
    group = n.select(F.concat(F.lit("@"), F.when(F.col("n_regionkey") < 2, "inner").otherwise("outer")).alias("allowed"), F.col("n_nationkey").alias("member"))
    own = F.array(F.when(F.col("n_nationkey") % 2 == 0, "@inner").otherwise("@outer"), F.col("n_nationkey").cast("string"))
    allow = n.select(F.col("n_nationkey").alias("role"), F.explode(own).alias("allowed"))
    return allow.join(group, "allowed", "left").select("role", F.coalesce("member", F.expr("try_cast(allowed AS int)")).cast("int").alias("target")).distinct()


@query("SELECT user_id, day, event_type, event_id FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, event_type, event_id FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY event_id) = 1")
def statement_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each statement key, the first in order."""
    e = t(spark, sf, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), "event_type", "event_id")
    return e.groupBy("user_id", "day", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS k FROM orders), w AS (SELECT *, 'x' || o_custkey AS x, 'y' || o_orderkey AS y FROM a)
SELECT o_orderkey, 'a' AS parameter, x AS value FROM w WHERE k IN (0, 1, 2) UNION ALL SELECT o_orderkey, 'b', y FROM w WHERE k IN (1, 2)""")
def argument_binding(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of calls bound to parameters: by place, by name, and calls that bind nothing."""
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("k"), F.concat(F.lit("x"), F.col("o_custkey").cast("string")).alias("x"), F.concat(F.lit("y"), F.col("o_orderkey").cast("string")).alias("y"))
    arg = lambda name, at, value: F.struct(F.lit(name).cast("string").alias("name"), F.lit(at).cast("int").alias("position"), F.col(value).alias("value"))
    forms = [[arg(None, 0, "x")], [arg(None, 0, "x"), arg(None, 1, "y")], [arg("b", None, "y"), arg("a", None, "x")], [arg(None, 0, "x"), arg("a", None, "y")], [arg("b", None, "y")], [arg(None, 0, "x"), arg("c", None, "y")]]
    args = F.coalesce(*[F.when(F.col("k") == n, F.array(*form)) for n, form in enumerate(forms)])
    calls = o.select(F.col("o_orderkey").alias("call_id"), F.lit("f").alias("function"), args.alias("args"))
    params = spark.createDataFrame([("f", "a", 0, "positional_or_keyword", True), ("f", "b", 1, "positional_or_keyword", False)], "function string, name string, position int, kind string, required boolean")
    return joins.bind_arguments(calls, params).withColumnRenamed("call_id", "o_orderkey")


@query("SELECT o_custkey, list_has_any(list(DISTINCT o_orderpriority), ['1-URGENT', '2-HIGH']) AS urgent FROM orders GROUP BY o_custkey")
def shared_members(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a set shares a member with a fixed one."""
    sets = t(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return sets.select("o_custkey", joins.overlaps(F.col("s"), ["1-URGENT", "2-HIGH"]).alias("urgent"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def missed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What changed but was not proposed for recomputation."""
    from ..streaming.incremental import missed

    o = t(spark, sf, "orders")
    return missed(o.where("o_orderstatus = 'F'").select("o_custkey"), o.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct())


@query("(SELECT s_nationkey AS n FROM supplier WHERE s_acctbal < 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) UNION (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Nations that one of two sets has and the other has not."""
    return joins.symmetric_difference(t(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("n")), t(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n")))


@query("SELECT user_id, count(*) FILTER (event_type = 'view')::BIGINT AS complete, count(*) FILTER (event_type IS DISTINCT FROM 'view')::BIGINT AS incomplete, count(*)::BIGINT AS total FROM events GROUP BY user_id")
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """Complete and incomplete members counted."""
    return aggregates.completeness_counts(t(spark, sf, "events").select("user_id", (F.col("event_type") == "view").alias("complete")), ["user_id"])


@query("SELECT l_suppkey, median(l_quantity) AS median, quantile_disc(l_quantity, 0.95) AS p95, max(l_quantity) AS largest FROM lineitem GROUP BY l_suppkey")
def spread(spark: SparkSession, sf: str) -> DataFrame:
    """Median, 95th percentile by nearest rank, and maximum."""
    return aggregates.spread(t(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity")


@query("SELECT o_orderkey, coalesce(bool_and(l_quantity > 10), true) AS all_large FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def all_or_none(spark: SparkSession, sf: str) -> DataFrame:
    """A condition on all members of a group, which an empty group fulfils."""
    items = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return t(spark, sf, "orders").select("o_orderkey").join(items, "o_orderkey", "left").groupBy("o_orderkey").agg(aggregates.every(F.col("l_quantity") > 10).alias("all_large"))


def sources_of(rows: DataFrame) -> DataFrame:
    """rows of path and content as the sources of a project."""
    module = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    return rows.select("path", module.alias("module_id"), F.lit(False).alias("is_package"), "content", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"), (F.size(F.split("content", "\n")) - 1).alias("line_count"), F.lit("analyzed").alias("status"))


def case_modules(spark: SparkSession, sf: str) -> DataFrame:
    """path, content, rule_id: a module for each customer, of the case that its key falls on."""
    shown = [(n, rule_cases.module_path(n), rule, "x = 1\n" if text == "conftest" else text.replace("{{", "{").replace("}}", "}")) for n, (rule, _, _, _, text) in enumerate(rule_cases.CASES)]
    cases = spark.createDataFrame(shown, "n int, path string, rule_id string, text string")
    k = t(spark, sf, "customer").select("c_custkey", F.pmod("c_custkey", F.lit(len(shown))).cast("int").alias("n"))
    fill = lambda text, mark, value: F.replace(text, F.lit(mark), value)
    m = k.join(F.broadcast(cases), "n").withColumn("path", fill(F.col("path"), "{k}", F.col("c_custkey").cast("string")))
    name = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".")
    return m.select("path", fill(fill(F.col("text"), "{k}", F.col("c_custkey").cast("string")), "{m}", name).alias("content"), "rule_id")


@query(f"""WITH cases(n, rule_id, verdict, reason) AS (VALUES {rule_cases.values()})
SELECT rule_id, verdict, reason, count(*)::BIGINT AS modules FROM customer JOIN cases ON c_custkey % {len(rule_cases.CASES)} = n GROUP BY ALL""")
def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over a project with a module for each customer that breaks a rule, keeps it, leaves it open or has
    nothing to do with it."""
    from ..sources.policy import complete
    from .report import check_sources

    modules = written(case_modules(spark, sf))
    library = spark.createDataFrame(list(rule_cases.LIBRARY.items()), "path string, content string")
    report = check_sources(sources_of(modules.select("path", "content").union(library)), complete(rule_cases.POLICY))
    return report.evaluations.join(modules.select("path", "rule_id"), ["path", "rule_id"]).groupBy("rule_id", "verdict", "reason").agg(F.count("*").alias("modules"))


@query("""WITH m AS (SELECT s_acctbal < 1000 AS broken FROM supplier), r AS (SELECT unnest(['ARCH002', 'EXC001', 'IMPORT002', 'TIME001']) AS rule_id)
SELECT rule_id, CASE WHEN broken OR rule_id IN ('ARCH002', 'EXC001') THEN 'indeterminate' ELSE 'pass' END AS verdict,
CASE WHEN broken THEN 'incomplete_module' WHEN rule_id IN ('ARCH002', 'EXC001') THEN 'incomplete_project' END AS reason, count(*)::BIGINT AS modules FROM m, r GROUP BY ALL""")
def incomplete_projects(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of a project with modules that can't be read: rules on the whole project are open everywhere."""
    from ..sources.policy import complete
    from .report import check_sources

    s = t(spark, sf, "supplier").select(F.concat(F.lit("app/m"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), F.when(F.col("s_acctbal") < 1000, "def (:\n").otherwise("x = 1\n").alias("content"))
    report = check_sources(sources_of(s), complete({}), rules=["ARCH002", "EXC001", "IMPORT002", "TIME001"])
    return report.evaluations.groupBy("rule_id", "verdict", "reason").agg(F.count("*").alias("modules"))


@query("SELECT 'app.m' || s_suppkey AS module_id, s_suppkey % 2 = 0 AS same FROM supplier")
def location_free_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a module means the same in two revisions: in half of them lines have only moved."""
    from ..sources.extract import extract
    from ..streaming.incremental import semantic_digests

    s = t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("app/m"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"))
    text = "import json\ndef f(x):\n    return json.dumps(x)\n"
    before = s.select("path", F.lit(text).alias("content"))
    after = s.select("path", F.concat(F.lit("\n# moved\n"), F.when(F.col("s_suppkey") % 2 == 0, text).otherwise(text.replace("dumps", "loads"))).alias("content"))
    a, b = (semantic_digests(extract(sources_of(x))) for x in (before, after))
    return a.join(b.withColumnRenamed("digest", "other"), "module_id").select("module_id", (F.col("digest") == F.col("other")).alias("same"))


def framework_views(framework: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from ..sources.policy import complete
        from .capabilities import BASE, VIEWS
        from .facts import Catalog

        catalog = Catalog(supplier_modules(spark, sf, view_cases.SOURCES[framework]), complete({}))
        shown = []
        for name in sorted(v for v in VIEWS if v.startswith(f"{framework}.")):
            rows = VIEWS[name](catalog)
            own = [c for c in rows.columns if c not in (*BASE, "symbol", "confidence", "response_model")]
            shown.append(rows.select("module_id", F.lit(name).alias("shown_by"), "symbol", F.to_json(F.struct(*own)).alias("own")))
        return functools.reduce(DataFrame.unionAll, shown)

    run.__name__, run.__doc__ = f"{framework}_views", f"All {framework} views of modules that use it, in two ways, and of modules that only seem to."
    return run


for _framework in view_cases.SOURCES:
    query(view_cases.sql(_framework))(framework_views(_framework))


def supplier_modules(spark: SparkSession, sf: str, forms: list[str]) -> DataFrame:
    """Sources with a module for each supplier, of the form that its key falls on."""
    texts = spark.createDataFrame(list(enumerate(forms)), "n int, content string")
    k = t(spark, sf, "supplier").select("s_suppkey", F.pmod("s_suppkey", F.lit(len(forms))).cast("int").alias("n"))
    return sources_of(k.join(F.broadcast(texts), "n").select(F.concat(F.lit("app/m"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"), "content"))


@query(fact_cases.sql())
def extracted_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Imports, definitions, decorators, fields and calls of modules, with what their names stand for, and failures."""
    from ..sources.extract import extract

    facts = extract(supplier_modules(spark, sf, fact_cases.SOURCES)).where("kind NOT IN ('binding', 'reference')")
    return facts.select("module_id", "line", F.col("column").alias("place"), "kind", F.coalesce("symbol", "name").alias("symbol"), "state", F.array_join("candidates", ",").alias("candidates"), "owner", "guard", "phase")


@query(fact_cases.comments_sql())
def inline_directives(spark: SparkSession, sf: str) -> DataFrame:
    """Ignores in comments, and the issues of malformed and unknown ones."""
    from ..sources.policy import RULES
    from ..sources.scan import inline_ignores

    return inline_ignores(supplier_modules(spark, sf, [f"\n{text}\n" for text, _, _ in fact_cases.COMMENTS]), list(RULES))


FILES = """f AS (SELECT p_partkey AS k, p_partkey % 8 AS n, CASE p_partkey % 8 WHEN 0 THEN 'src/app/m' || p_partkey || '.py' WHEN 1 THEN 'src/app/m' || (p_partkey - 1) || '.pyi' WHEN 2 THEN 'src/.venv/m' || p_partkey || '.py'
  WHEN 3 THEN 'src/gen/m' || p_partkey || '.py' WHEN 4 THEN 'src/gen/keep' || p_partkey || '.py' WHEN 5 THEN 'src/plug/m' || p_partkey || '.py' WHEN 6 THEN 'docs/m' || p_partkey || '.py' ELSE 'src/app/odd' || p_partkey || '.py' END AS path FROM part)"""


def part_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: a file for each part, that is a source, a stub beside one, ignored, excluded, included by force,
    below a nested source root, outside of all, or no UTF-8."""
    k = F.col("p_partkey").cast("string")
    forms = [("src/app/m", k, ".py"), ("src/app/m", (F.col("p_partkey") - 1).cast("string"), ".pyi"), ("src/.venv/m", k, ".py"), ("src/gen/m", k, ".py"), ("src/gen/keep", k, ".py"), ("src/plug/m", k, ".py"), ("docs/m", k, ".py"), ("src/app/odd", k, ".py")]
    form = F.pmod("p_partkey", F.lit(len(forms)))
    path = F.coalesce(*[F.when(form == n, F.concat(F.lit(a), key, F.lit(b))) for n, (a, key, b) in enumerate(forms)])
    content = F.when(form == 7, F.unhex(F.lit("78FF"))).otherwise(F.concat(F.lit("x = "), k, F.lit("\n")).cast("binary"))
    return t(spark, sf, "part").select(path.alias("path"), content.alias("content"))


def scanned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from ..sources.scan import place

    return place(part_files(spark, sf), ["src", "src/plug"], exclude=["src/gen/*"], force_include=["src/gen/keep*"])


@query(f"""WITH {FILES} SELECT path, CASE n WHEN 0 THEN 'app.m' || k WHEN 1 THEN 'app.m' || (k - 1) WHEN 2 THEN '_venv_' || substr(sha256('.venv'), 1, 8) || '.m' || k WHEN 3 THEN 'gen.m' || k WHEN 4 THEN 'gen.keep' || k ELSE 'm' || k END AS module_id,
CASE WHEN n IN (2, 3) THEN 'excluded' WHEN n = 1 AND EXISTS (SELECT 1 FROM f g WHERE g.n = 0 AND g.k = f.k - 1) THEN 'shadowed_stub' ELSE 'analyzed' END AS status, sha256(CASE WHEN n = 7 THEN '' ELSE 'x = ' || k || chr(10) END) AS content_hash, 1 AS line_count FROM f WHERE n < 6""")
def source_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Files placed below source roots: stubs beside sources, exclusions, forced inclusions and nested roots."""
    return scanned(spark, sf)[0].select("path", "module_id", "status", "content_hash", "line_count")


@query(f"WITH {FILES} SELECT 'SOURCE_READ_FAILURE' AS code, path, 'the file is no UTF-8' AS message FROM f WHERE n = 7")
def scan_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of a scan: files that can't be read."""
    return scanned(spark, sf)[1]
