"""A corpus pipeline: quality, exact copies, near copies, mixture, token ids. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, pieces, quality, simhash
from tessera.llm.common import forget, fresh_path

#: Rows depend on a trained model and on SimHash candidates, so no SQL gives them; tests hold stages against brute force.
ORACLE_SQL = None
VOCABULARY = "piece_bpe_32k.model"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; all of them where no label could be learned from."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return quality.score(docs, model, keep=tuple(docs.columns), out_col="__score").where(f"__score >= {quality.THRESHOLD}").select(docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.drop_near_duplicates(docs, 5, 0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; those of small sources again, up to twice, so that the tempered weights are met."""
    return mixing.mix(docs, max_repeats=2.0).select(docs.columns)


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, every whole document checked against the library, and a digest of the text that they decode to."""
    import public_tokenizers

    made = ("n_tokens", "ids", "decoded_sha256")
    keep = tuple(c for c in docs.columns if c not in ("text", *made))
    return pieces.encode_documents(docs, public_tokenizers.path(VOCABULARY), made, keep, check="documents")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact),
    ("simhash near-dedup", drop_near),
    ("mixing", mix_sources),
    ("sentencepiece", to_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # between stages Parquet in the shared folder, as between jobs
            docs.write.parquet(at := fresh_path(spark, "stage"))
            docs = spark.read.parquet(at)
            if before is not None:
                forget(spark, before)
            before = at
    return docs
