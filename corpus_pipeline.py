"""The corpus pipeline: one stage after another, each written as Parquet and read again as the next one's documents.

No stage can be said in SQL as a whole (a trained network, a trained scanner, iterated rates, a packing plan), so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathlake.llm import jaccard, language, mixing, packing, secrets
from swathlake.llm.shared import anti_by_id, semi_by_id, written
from swathlake.llm.tokens import vocabulary_path

#: A language below this score rejects a document.
LEAST_SCORE = 0.5
#: A document's fitted rate below this rounds to none; target shares of the tokens that clean and toxic domains now have.
LEAST_RATE = 0.5
CLEAN_SHARE, TOXIC_SHARE = 1.0, 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough score; texts that are null or have no letter go."""
    columns = tuple(docs.columns)
    model = language.fit(docs)
    seen = language.identify(docs.withColumn("__id", F.col("doc_id")), model, id_col="__id", carry=columns)
    names = [f"c{k}" for k in range(len(columns) + 3)]
    return seen.toDF(*names).where(f"c1 <> '{language.UNKNOWN}' and c2 >= {LEAST_SCORE}").select(*[F.col(f"c{k + 3}").alias(c) for k, c in enumerate(columns)])


def row_key(docs: DataFrame):
    """A document's identity: its id and its text, as ids may repeat."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5("text"), F.lit(""))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, similarity 0.8 or more; the smallest id stays, of rows with one id and different texts the smallest digest. Rows that repeat an id and its text are one document, the smallest of them; texts without words are linked with nothing and stay."""
    keyed = docs.withColumn("__key", row_key(docs))
    ids = keyed.select(F.struct("doc_id", "__key").alias("row"), "text")
    found = written(jaccard.classes(ids, words=5, percent=80, id_col="row").where("n_shingles > 0").select(F.col("doc_id.__key").alias("__key"), (F.col("doc_id") == F.col("component_id")).alias("first")), "classes")
    left = anti_by_id(keyed, found.where("not first").select("__key").distinct(), "__key")
    repeated = written(found.where("first").groupBy("__key").count().where("count > 1").select("__key"), "repeated")
    if not repeated.isEmpty():
        one = semi_by_id(left, repeated, "__key").groupBy("__key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*", "__key")
        left = anti_by_id(left, repeated, "__key").unionByName(one)
    return left.select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars counted again."""
    columns = docs.columns
    net = secrets.fit(docs)
    masked = secrets.scan(docs, net, redacted=True, carry=tuple(c for c in columns if c not in ("doc_id", "text", "n_chars")))
    return masked.withColumnRenamed("redacted", "text").withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The clean domains keep CLEAN_SHARE of their expected tokens, the toxic ones TOXIC_SHARE: documents go whose fitted rate, 1 at most, rounds to none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    multiples = {d: CLEAN_SHARE if d.endswith("clean") else TOXIC_SHARE for d in mixing.DOMAINS}
    keyed = docs.withColumn("__key", row_key(docs))
    rates = written(mixing.mix(keyed, labels, multiples=multiples, most=1.0, key="__key").select("key", "rate"), "rates")
    return anti_by_id(keyed, rates.where(F.col("rate") < LEAST_RATE).select(F.col("key").alias("__key")).distinct(), "__key").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return packing.pack(written(packing.pieces(docs, vocabulary_path()), "pieces"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
