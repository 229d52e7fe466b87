"""python -m lattica check|audit|rules|config|init <root>"""

import argparse
import json
import sys
import tomllib

from pyspark.sql import SparkSession

from .plans.assurance import audit
from .plans.onboarding import propose
from .plans.report import check
from .sources.policy import ADVISORY, RULES, PolicyError, load_document, load_policy, read_text


def session() -> SparkSession:
    made = SparkSession.builder.appName("lattica").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def members(spark: SparkSession, root: str, table: str) -> list[str]:
    """The projects below a root: those of its workspace table, or the root itself."""
    try:
        doc = tomllib.loads(read_text(spark, f"{root}/pyproject.toml")).get("tool", {}).get(table, {})
    except Exception as e:
        raise PolicyError(f"{root}/pyproject.toml can't be read: {str(e).splitlines()[0]}") from e
    if "workspace" not in doc:
        return [root]
    if set(doc) != {"workspace"}:
        raise PolicyError("a workspace's root has no policy of its own")
    found = sorted(doc["workspace"]["members"])
    for a, b in zip(found, found[1:]):
        if b.startswith(f"{a}/") or a == b:
            raise PolicyError(f"members overlap: {a} and {b}")
    return [f"{root}/{m}" for m in found]


def main(args: list[str] | None = None, out=sys.stdout) -> int:
    """Exit code 0: complete and compliant, 1: violations, 2: not reliable. Of several members the largest counts."""
    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    parser.add_argument("command", choices=["check", "audit", "rules", "config", "init"])
    parser.add_argument("root", nargs="?", default=".")
    parser.add_argument("--format", choices=["text", "json"], default="text")
    parser.add_argument("--table", default="lattica", help="the TOML table [tool.<table>] with the policy")
    parser.add_argument("--answers", help="a JSON file with decisions for init")
    o = parser.parse_args(args)
    if o.command == "rules":
        rules = [{"rule_id": r, "zones": {"A": "all", "P": "prod", "T": "test"}[z], "level": "advisory" if r in ADVISORY else "enforced"} for r, z in RULES.items()]
        print(json.dumps(rules, indent=1) if o.format == "json" else "\n".join(f"{r['rule_id']} {r['zones']} {r['level']}" for r in rules), file=out)
        return 0
    spark, root, codes = session(), o.root.rstrip("/") or "/", []
    if o.command == "init":
        proposal = propose(spark, root, json.loads(read_text(spark, o.answers)) if o.answers else None, o.table)
        print(json.dumps(proposal, indent=1) if o.format == "json" else proposal["toml"] + "".join(f"# open: {x}\n" for x in proposal["questions"]), file=out)
        return 2 if proposal["questions"] else 0
    try:
        for member in members(spark, root, o.table):
            path = f"{member}/pyproject.toml"
            if o.command == "config":
                load_policy(spark, path, o.table)
                print(json.dumps(load_document(spark, path, o.table), sort_keys=True, indent=1), file=out)
                codes.append(0)
                continue
            report = check(spark, member, None, o.table)
            if o.command == "audit":
                found = [r.asDict() for r in audit(report).orderBy("code", "subject").collect()]
                print(json.dumps(found, indent=1) if o.format == "json" else "\n".join(f"{r['code']} {r['subject']} {r['detail'] or ''}".rstrip() for r in found), file=out)
                codes.append(2 if found else 0)
            else:
                print(report.to_json() if o.format == "json" else report.to_text(), file=out)
                codes.append(report.exit_code)
    except PolicyError as e:
        print(json.dumps({"code": "INVALID_CONFIGURATION", "message": str(e)}) if o.format == "json" else f"INVALID_CONFIGURATION {e}", file=out)
        codes.append(2)
    return max(codes, default=0)
