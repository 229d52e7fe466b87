"""A corpus from raw documents to packed sequences: STAGES in their order, and run() over the table documents.

Each stage works on all that the one before kept. Toxic documents go, one of each group of near copies stays, documents
that hold a benchmark item go, secrets are masked in the texts, and what is left is packed.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.decontamination import drop_contaminated
from lattica.llm.ngram_join import jaccard_join
from lattica.llm.packing import pack_digest
from lattica.llm.queries import tokenizer_path
from lattica.llm.secrets import redact
from lattica.llm.text import written
from lattica.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected severity is that of a toxic one.

    A null or empty text is clean; repeated rows have one fate; rows without an id are judged like others; without labels
    of both kinds all rows stay; an empty table gives an empty one; other columns are kept, and any named severity,
    severity_grade or toxic_rejected is lost."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, labels).where("NOT toxic_rejected")
    return found.select(*(c for c in docs.columns if c in found.columns and c not in ("severity", "severity_grade", "toxic_rejected")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 on five-word shingles, the one with the smallest id.

    Rows without an id, words or text are in no group and stay. Rows that share an id are one document: equal ones stay
    together or go together (no row can be told from the others), and if any of an id's texts is a copy of a document of
    a smaller id, all its rows go. An empty table gives an empty one; other columns are kept, whatever their names."""
    joined = jaccard_join(docs, n=5, num=80, den=100)
    return docs.join(joined.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a test item.

    A null or empty text holds none; repeated rows have one fate; rows without an id are judged like others; an empty
    benchmark or table changes nothing; other columns are kept, but for one named test_items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of each secret, and n_chars counted anew (null for a null text).

    Null and empty texts stay as they are; every row is kept, repeated ones and those without an id too; an empty table
    gives an empty one; other columns are kept, but for one named secret_spans."""
    found = redact(docs).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*(c for c in docs.columns if c != "secret_spans"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences.

    A null or empty text is the end mark alone; repeated rows are packed each; a row without an id is packed under a null
    one; an empty table gives no pieces; other columns are ignored, whatever their names."""
    return pack_digest(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_items),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

#: Trained models, similarity components and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
