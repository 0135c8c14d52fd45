"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, benchmark
contamination, tokens. Each stage works on all that the one before it kept, written as Parquet.

Documents that a filter does not reject keep all their columns. The suffix stage shortens texts
(characters cut by a removed run are dropped) and brings n_chars up to date; it keeps documents that
it leaves empty. The last stage returns doc_id, lang, source, n_tokens, ids, ids_sha256 and
decoded_sha256. A null text is an empty one in every stage; empty texts are kept (they hold no toxic word,
repeat or benchmark window and are near copies of nothing). Rows with the same id and text are one document; an id with two
texts is two. Rows without an id are never near copies. Very long texts are processed whole in every stage, and an
empty table gives an empty result. Other columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raschmill.llm.bpe import round_trip
from raschmill.llm.common import written
from raschmill.llm.decontam import drop_contaminated
from raschmill.llm.near_dedup import drop_near_duplicates
from raschmill.llm.suffix_dedup import remove_repeats
from raschmill.llm.toxicity import drop_toxic, fit_from

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = remove_repeats(docs)
    columns = {c: F.col(f"row.{c}") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    carried = docs.withColumn("doc_id", F.struct("doc_id", "lang", "source"))
    out = round_trip(carried, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return out.select("id.doc_id", "id.lang", "id.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: A fitted model, sampled bands and tokens are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
