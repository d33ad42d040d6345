"""From raw documents to packed sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.

Extra columns of ``docs`` are carried along as they are, whatever their names:
an operator sees ``doc_id``, ``text`` and one column that holds all the others.
Empty tables pass through; what each stage does with nulls, ties and repeated
rows stands with its operator.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm import linededup, packing, quality, simhash
from themeloom.llm.bpe import vocabulary_path
from themeloom.plans.staging import staged


CARRIED = "carried"


def _carrying(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ids and texts, with all other columns beside them untouched."""
    others = [name for name in docs.columns if name not in ("doc_id", "text")]
    parts = [F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(others)]
    packed = F.struct(*parts, F.lit(0).alias("none")).alias(CARRIED)
    done = work(docs.select("doc_id", "text", packed))
    at = {name: f"c{i}" for i, name in enumerate(others)}
    return done.select(
        *[
            F.col(CARRIED).getField(at[name]).alias(name) if name in at else F.col(name)
            for name in docs.columns
        ]
    )


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as label 1; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return _carrying(docs, lambda own: quality.score_documents(own, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` is counted anew."""
    kept = _carrying(docs, linededup.dedup_lines)
    if "n_chars" not in docs.columns:
        return kept
    length = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return kept.select(*[length if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id."""
    return _carrying(docs, lambda own: simhash.keep_first(own, simhash.WORDS, simhash.RADIUS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    texts = docs.select("doc_id", "text")
    return packing.pack_documents(texts, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("best-fit packing", best_fit_packing),
]

# The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
