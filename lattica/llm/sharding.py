"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Compaction looks at shards by size: those of one tier (sizes
within a factor of FAN) are runs alike, and as soon as FAN of them lie together they are merged into one of the next tier,
up to the target size. The merges are planned on sizes alone, tier after tier, and each final file is then written once,
straight from the smallest shards it is made of, so data are not rewritten at every tier. A task merges one group, whose
bytes the target bounds, row group by row group; there is no shuffle.

What exists is what the newest manifest says: a manifest tells what a version adds and drops (one in WHOLE lists all live
shards), is written beside its place and moved there only if no other writer has committed that version, and is never
changed. A reader of an older version
keeps its files until vacuum(). Files of failed tasks are named in no manifest.

Defined results: rows are kept as they are, repeated ones, nulls and extra columns (also one named _shard) included; their order in a shard is the
order of the merged shards; an empty arrival commits a version without new shards.
"""

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Folder, commit_text, hadoop_path, read_text, unique
from .text import shared_folder

#: Shards that make a run, and the ratio of the sizes of neighbouring tiers.
FAN = 4
#: Bytes that a merged shard should have, and those below which all shards are of the lowest tier.
TARGET, SMALLEST = 128 << 20, 1 << 20
#: Of so many manifests one lists all shards.
WHOLE = 16
#: Rows of an arriving shard.
ARRIVAL_ROWS = 2000


class Shards:
    """A versioned set of shards under a folder. Shards: path (below the folder) and bytes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        fs, path = hadoop_path(self.spark, f"{self.folder}/manifests")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """version, schema and shards of a version (by default the newest): what its manifest and those before it, back to
        one that lists all shards, have added and dropped."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        steps = [self._step(version)]
        while not steps[-1]["whole"]:
            steps.append(self._step(steps[-1]["version"] - 1))
        live: dict[str, int] = {}
        for step in reversed(steps):
            for path in step["drop"]:
                del live[path]
            live |= {s["path"]: s["bytes"] for s in step["add"]}
        return {"version": version, "schema": steps[0]["schema"], "shards": [{"path": p, "bytes": n} for p, n in live.items()]}

    def _step(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.folder}/manifests/v{version:08d}.json"))

    def commit(self, base: dict, add: list[dict], drop: list[str], schema: str | None) -> int:
        """Commits what follows base; fails if another writer was first. Only every WHOLE-th manifest lists all shards,
        others what changed, so a commit writes as much as it changes."""
        version = base["version"] + 1
        if whole := version % WHOLE == 1:
            gone = set(drop)
            add, drop = [s for s in base["shards"] if s["path"] not in gone] + add, []
        text = json.dumps({"version": version, "schema": schema or base["schema"], "whole": whole, "add": add, "drop": drop}, indent=0)
        if not commit_text(self.spark, f"{self.folder}/manifests/v{version:08d}.json", text):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Writes arrivals as small shards and commits them as a new version."""
        base, to = self.manifest(), unique("arrivals/batch", "")
        arrivals.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{self.folder}/{to}")
        fs, path = hadoop_path(self.spark, f"{self.folder}/{to}")
        new = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
        return self.commit(base, [{"path": f"{to}/{name}", "bytes": size} for name, size in new], [], arrivals.schema.json())

    def compact(self, target: int = TARGET, fan: int = FAN, smallest: int = SMALLEST) -> int:
        """Merges runs of similar sizes and commits the outcome; returns the version."""
        base = self.manifest()
        groups = plan_merges([s["bytes"] for s in base["shards"]], target, fan, smallest)
        merged = [g for g in groups if len(g) > 1]
        if not merged:
            return base["version"]
        shards, folder = base["shards"], self.folder
        jobs = [(k, [shards[i]["path"] for i in g]) for k, g in enumerate(merged)]
        df = self.spark.createDataFrame(jobs, "job long, paths array<string>").repartition(len(jobs))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = Folder(folder)
            for b in batches:
                for job, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    name = unique(f"merged/run-{job:06d}", ".parquet")
                    size = merge_files(place, paths, name)
                    yield pa.RecordBatch.from_arrays([pa.array([job], pa.int64()), pa.array([name]), pa.array([size], pa.int64())], names=["job", "path", "bytes"])

        # one row for each file written; their number is the data's size over the target
        done = df.mapInArrow(merge, "job long, path string, bytes long").orderBy("job").collect()
        return self.commit(base, [{"path": r["path"], "bytes": r["bytes"]} for r in done], [shards[i]["path"] for g in merged for i in g], None)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest by default), with one more column, the path of a row's shard. It is called as
        shard_column() says: _shard, with more lines in front where the rows have a column of that name."""
        from pyspark.sql.types import StructType

        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError("nothing was appended yet")
        schema = StructType.fromJson(json.loads(found["schema"]))
        if not found["shards"]:
            return self.spark.createDataFrame([], schema).withColumn(shard_column(schema.names), F.lit(""))
        df = self.spark.read.schema(schema).parquet(*(f"{self.folder}/{s['path']}" for s in found["shards"]))
        return df.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"((arrivals/[^/]+|merged)/[^/]+)$", 1).alias(shard_column(schema.names)))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the files that only versions before the newest `keep` name, and returns their number."""
        versions = self.versions()
        live = {s["path"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        dead = {s["path"] for v in versions[:-keep] for s in self.manifest(v)["shards"]} - live
        for path in dead:
            fs, p = hadoop_path(self.spark, f"{self.folder}/{path}")
            fs.delete(p, False)
        return len(dead)


def shard_column(columns: list[str]) -> str:
    name, taken = "_shard", {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def tier(size: int, fan: int, smallest: int) -> int:
    n = 0
    while size >= smallest * fan ** (n + 1):
        n += 1
    return n


def plan_merges(sizes: list[int], target: int = TARGET, fan: int = FAN, smallest: int = SMALLEST) -> list[list[int]]:
    """The shards (by number) of which each future shard is made. From the lowest tier up, neighbours of one tier are
    joined, fan at a time or more while the target allows; a run shorter than fan waits."""
    runs = [([k], size) for k, size in enumerate(sizes)]
    level, top = 0, max(map(lambda s: tier(s, fan, smallest), [*sizes, target]), default=0)
    while level <= top:
        own = [r for r in runs if tier(r[1], fan, smallest) == level and r[1] < target]
        joined, merged = [], False
        for r in own:
            last = joined[-1] if joined else None
            if last and len(last) < 2 * fan and sum(x[1] for x in last) + r[1] <= target and sum(x[1] for x in last) < smallest * fan ** (level + 1) * fan:
                last.append(r)
            else:
                joined.append([r])
        mine = set(map(id, own))
        rest = [r for r in runs if id(r) not in mine]
        for group in joined:
            if len(group) >= fan or len(group) > 1 and sum(x[1] for x in group) > target // 2:
                rest.append((sorted(k for x in group for k in x[0]), sum(x[1] for x in group)))
                merged = True
            else:
                rest += group
        runs = sorted(rest, key=lambda r: r[0][0])
        if not merged or not any(tier(r[1], fan, smallest) == level and r[1] < target for r in runs):
            level += 1
    return [r[0] for r in runs]


def merge_files(place: Folder, paths: list[str], name: str) -> int:
    """Copies the row groups of paths to one file; returns its bytes."""
    writer, out = None, place.create(f"{name}.open")
    for path in paths:
        with place.open(path) as file:
            source = pq.ParquetFile(file)
            if writer is None:
                kept = {k: v for k, v in (source.schema_arrow.metadata or {}).items() if k.startswith(b"org.apache.spark")}
                writer = pq.ParquetWriter(out, source.schema_arrow.with_metadata(kept), compression="zstd")
            for batch in source.iter_batches(batch_size=4096):
                writer.write_batch(batch)
    writer.close()
    out.close()
    place.move(f"{name}.open", name)
    with place.open(name) as file:
        file.seek(0, 2)
        return file.tell()


def shard_digest(docs: DataFrame, target: int = TARGET) -> DataFrame:
    """Appends docs as an arrival of small shards, compacts them, reads the newest version back, and returns a row for each document:
    doc_id, shard, and bytes and SHA-256 of its text."""
    spark = docs.sparkSession
    shards = Shards(spark, shared_folder(spark))
    shards.append(docs)
    shards.compact(target)
    shards.vacuum()
    text = F.col("text").cast("binary")
    return shards.read().select("doc_id", F.col(shard_column(docs.columns)).alias("shard"), F.octet_length(text).cast("long").alias("text_bytes"), F.sha2(text, 256).alias("text_sha256"))
