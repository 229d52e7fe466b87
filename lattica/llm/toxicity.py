"""Toxicity by cumulative-link ordinal regression.

The features of a text are the distinct words it holds and their beginnings of 4 to 6 bytes, hashed to buckets. One weight vector is shared by all thresholds:
P(grade > k) = logistic(w.x - cut_k) with ascending cuts, and the expected severity of a text is the sum of these over k.

Labels say only whether a text is toxic, so graded targets are made from them: words that come mostly in toxic texts are
found by their log-odds, and a toxic text is graded 1 to 3 by how many different ones of these it holds. Texts that are
not toxic have grade 0.

The model is fitted on a bounded sample of labelled rows (sample_rows, chosen by a hash of the id). Their buckets are
counted in place; what reaches the driver is the counts and, for each row, the few buckets that are worth a weight. Scoring is one pass over all rows and whole texts, without a shuffle; the weights
are a table of fixed size that is shipped with the task.

Defined results: a null or empty text has no features and gets the severity of the intercepts alone, that is the clean
one; labels that are null count for nothing; of several labels of one id the largest holds; without labels of both kinds
nothing is toxic; repeated rows give repeated results; other columns are kept.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .text import Cache, bound_batches, kept, plain_words, written

BUCKETS = 1 << 18
GRADES = 3
#: Lengths of beginnings of words, in bytes of UTF-8.
PREFIXES = (4, 5, 6)
#: From this expected severity on a text is rejected.
REJECT = 0.5
#: Penalty on squared weights.
RIDGE = 0.0003


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of how it begins: inflected words share their stems."""
    found = {xxhash.xxh3_64_intdigest(word) >> 46}
    found.update(xxhash.xxh3_64_intdigest(word[:n], seed=n) >> 46 for n in PREFIXES if n < len(word))
    return tuple(found)


def buckets_of(words: list[bytes], cache: Cache) -> np.ndarray:
    """Sorted distinct buckets of a text. cache: of word_buckets()."""
    return np.array(sorted(set().union(*map(cache.__getitem__, set(words)))), np.int32)


class Sample:
    """Of labelled rows, one of each set of words and label: toxic (0 or 1), and cells, those of a row's buckets that are
    worth a weight. kept: all such buckets, sorted; marks: those of them that come mostly in toxic rows."""

    def __init__(self, toxic: np.ndarray, cells: list[np.ndarray], kept: np.ndarray, marks: np.ndarray):
        self.toxic, self.cells, self.kept, self.marks = toxic, cells, kept, marks

    def grades(self) -> np.ndarray:
        """1 to GRADES of a toxic row by how many marks it holds, 0 of others."""
        held = np.array([np.isin(c, self.marks).sum() for c in self.cells], int)
        return np.where(self.toxic > 0, np.clip(held, 1, GRADES), 0)


def worth(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(worth a weight, a mark) of buckets that so many toxic and clean rows hold: enough toxic rows do, and few others."""
    enough = toxic >= max(4, 0.01 * n_toxic)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return enough & (odds > 2), enough & (odds > 2.5)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> Sample:
    """Of at most sample_rows labelled rows. Buckets are counted where the rows are; the driver gets the counts of buckets
    that enough toxic rows hold (at most BUCKETS of them), and then each row's buckets among those worth a weight."""
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    schema = StructType([StructField("toxic", IntegerType()), StructField("x", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = kept("buckets", None, lambda: Cache(word_buckets))
        for b in batches:
            rows = [buckets_of(plain_words(t or ""), cache) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(rows, arrow.field("x").type)], schema=arrow)

    # the sample is of sample_rows rows at most, so it may be broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"), "text")
    rows = written(joined.mapInArrow(of, schema).distinct())
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.select("toxic", F.explode("x").alias("bucket")).groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.where(F.col("t") >= max(4, 0.01 * n_toxic)).orderBy("bucket").toPandas()
    has_weight, is_mark = worth(counts["t"].to_numpy(float), counts["c"].to_numpy(float), n_toxic, n_clean)
    buckets = counts["bucket"].to_numpy(np.int32)
    wanted = buckets[has_weight]

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.intersect1d(np.asarray(x, np.int32), wanted) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, arrow.field("x").type)], schema=arrow)

    table = rows.mapInArrow(cells, schema).toArrow()
    found = sorted(zip(table["toxic"].to_pylist(), table["x"].to_pylist()))
    return Sample(np.array([y for y, _ in found], int), [np.array(x, int) for _, x in found], wanted, buckets[is_mark])


class Ordinal:
    """weights (by bucket, most are 0) and ascending cuts."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        self.weights = dict(zip(buckets.tolist(), weights.tolist()))
        self.cuts = cuts

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -40, 40)))).sum(1)


def fit(sample: Sample, steps: int = 400, rate: float = 0.05, ridge: float = RIDGE) -> Ordinal:
    """Maximum likelihood of the grades with a ridge penalty, by gradient ascent (Adam) with a falling rate."""
    if len(set(sample.toxic.tolist())) < 2:
        return Ordinal(np.zeros(0, int), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    grades, kept = sample.grades(), sample.kept
    n, size = len(grades), len(kept)
    cells = [np.searchsorted(kept, c) for c in sample.cells]
    row, col = np.repeat(np.arange(n), [len(c) for c in cells]), np.concatenate([*cells, np.zeros(0, int)]).astype(int)
    share = np.clip((grades[:, None] > np.arange(GRADES)).mean(0), 1e-4, 1 - 1e-4)
    # the first cut, and logarithms of the steps to the others, which keeps cuts ascending
    start = np.log((1 - share) / share)
    w = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    each = np.arange(n)
    for step in range(1, steps + 1):
        gaps = np.exp(w[size + 1 :])
        cuts = w[size] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(np.clip(cuts[None, :] - score[:, None], -40, 40)))
        # P(grade = k) = edges[k] - edges[k + 1]
        edges = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        upper, lower = edges[each, grades], edges[each, grades + 1]
        like = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / like, lower * (1 - lower) / like
        of_cut = np.array([(down[grades == k].sum() - up[grades == k + 1].sum()) / n for k in range(GRADES)])
        grad = np.concatenate([np.bincount(col, (up - down)[row], size) / n - ridge * w[:size], [of_cut.sum()], gaps * np.cumsum(of_cut[:0:-1])[::-1]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = w[size] + np.concatenate([[0], np.cumsum(np.exp(w[size + 1 :]))])
    return Ordinal(kept, w[:size], cuts)


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, reject: float = REJECT) -> DataFrame:
    """The rows of docs with severity double (expected grade, 0 to 3), severity_grade int (its nearest grade) and
    toxic_rejected boolean (severity >= reject). docs has doc_id and text, labels doc_id and toxic;
    columns of these names are replaced."""
    docs = docs.drop("severity", "severity_grade", "toxic_rejected")
    bound_batches(docs.sparkSession)
    model = fit(labelled_sample(docs, labels, sample_rows))
    new = StructType([StructField("severity", DoubleType()), StructField("severity_grade", IntegerType())])
    schema = StructType([*docs.schema.fields, *new.fields])
    key = hash((tuple(model.weights.items()), tuple(model.cuts)))
    names, at = [f.name for f in schema.fields], docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = kept("weights", key, lambda: Cache(lambda word: tuple((k, model.weights[k]) for k in word_buckets(word) if k in model.weights)))
        for b in batches:
            scores = []
            for t in b.column(at).to_pylist():
                held = dict(pair for pairs in map(weighted.__getitem__, set(plain_words(t or ""))) for pair in pairs)
                scores.append(sum(held[k] for k in sorted(held)))
            s = model.severity(np.array(scores))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(np.rint(s).astype(np.int32))], names=names)

    return docs.mapInArrow(score, schema).withColumn("toxic_rejected", F.col("severity") >= reject)
