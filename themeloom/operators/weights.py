"""Term counts, the vocabulary, and TF-IDF weights.

The term matrix has one row per article and keeps its counts as a sparse
vector, so an article without a kept term is still there. Counting happens in
the article's row. The only shuffle is the one that adds up document
frequencies, and that is combined per task first.
"""

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Interaction
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom import schemas
from themeloom.functions import arrays
from themeloom.operators import heavy
from themeloom.operators.sizes import small

# Fixed value: how many terms are kept unless told otherwise.
NUM_TERMS = 1000


def term_frequency(lemmas: DataFrame) -> DataFrame:
    """``docid, term, tf`` for every kept lemma of every article.

    The sorted lemmas of a row form runs of equal words; a run's length is
    the count. Words therefore never leave their row to be counted.
    """
    in_order = lemmas.select("docid", F.sort_array("lemmas").alias("words"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words")),
        lambda i: (i < F.size("words"))
        & ((i == 0) | (F.get("words", i) != F.get("words", i - 1))),
    )
    runs = F.transform(
        "starts",
        lambda start, nth: F.struct(
            F.get("words", start).alias("term"),
            (F.coalesce(F.get("starts", nth + 1), F.size("words")) - start).alias("tf"),
        ),
    )
    # An outer explode, as an inner one would have Spark derive a filter on
    # the runs and compute them twice.
    return (
        in_order.withColumn("starts", starts)
        .select("docid", F.explode_outer(runs).alias("run"))
        .where(F.col("run").isNotNull())
        .select("docid", "run.term", "run.tf")
    )


def kept_in_article(lemmas: DataFrame) -> DataFrame:
    """``docid, n_lemmas``: all kept lemmas, in the vocabulary or not."""
    return lemmas.select("docid", F.size("lemmas").alias("n_lemmas"))


def _counted(lemmas: DataFrame) -> DataFrame:
    """Articles per term; the null term stands for all articles."""
    once = F.array_append(F.array_distinct("lemmas"), F.lit(None).cast("string"))
    return lemmas.select(F.explode_outer(once).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")
    )


def document_frequency(lemmas: DataFrame) -> DataFrame:
    """``term, df``: in how many articles a term occurs."""
    return _counted(lemmas).where(F.col("term").isNotNull())


@dataclass(frozen=True)
class Vocabulary:
    """The kept terms, most frequent first; a term's id is its rank from 0.

    Held on the driver: its size is the number of terms asked for.
    """

    n_docs: int
    terms: Sequence[str]
    dfs: Sequence[int]

    @property
    def idfs(self) -> list[float]:
        return [math.log(self.n_docs / df) for df in self.dfs]

    def table(self, spark: SparkSession) -> DataFrame:
        """``term_id, term, df, idf``."""
        rows = list(zip(range(len(self.terms)), self.terms, self.dfs, self.idfs))
        return spark.createDataFrame(rows, schemas.TERM_TABLE)


def build_vocabulary(
    lemmas: DataFrame, num_terms: int = NUM_TERMS, counters: int | None = None
) -> Vocabulary:
    """The ``num_terms`` terms found in most articles, ties by term.

    With ``counters``, each task keeps only so many before the exact count of
    the terms that can be among them (see ``heavy``); the result is the same.
    It pays where the different terms are many times those that are kept.
    """
    if counters is not None:
        n_docs, found = heavy.most_frequent(lemmas, num_terms, counters)
        if not found:
            raise ValueError("no article has a kept lemma")
        return Vocabulary(n_docs, [term for term, _ in found], [df for _, df in found])
    ranked = _counted(lemmas).orderBy(F.col("term").isNotNull(), F.desc("df"), "term")
    rows = ranked.limit(num_terms + 1).collect()
    if len(rows) < 2:
        raise ValueError("no article has a kept lemma")
    return Vocabulary(rows[0].df, [r.term for r in rows[1:]], [r.df for r in rows[1:]])


def term_matrix(lemmas: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docid, n_lemmas, tf``, and ``date`` where there is one."""
    counter = CountVectorizerModel.from_vocabulary(
        list(vocabulary.terms), inputCol="lemmas", outputCol="tf"
    )
    carried = [c for c in ("docid", "date") if c in lemmas.columns]
    return counter.transform(lemmas).select(*carried, F.size("lemmas").alias("n_lemmas"), "tf")


def weight_vectors(matrix: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The matrix with TF-IDF weights as an ML vector, ``features``."""
    share = matrix.withColumn("per_lemma", 1.0 / F.greatest("n_lemmas", F.lit(1)))
    relative = Interaction(inputCols=["tf", "per_lemma"], outputCol="relative").transform(share)
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(vocabulary.idfs), inputCol="relative", outputCol="features"
    )
    return weigh.transform(relative).drop("tf", "n_lemmas", "per_lemma", "relative")


def weight_rows(
    matrix: DataFrame, vocabulary: Vocabulary, weighting: str = "tfidf", keep_empty: bool = False
) -> DataFrame:
    """The matrix in long form: ``docid, term_id, weight``.

    ``weighting`` is ``tfidf`` or ``binary``. With ``keep_empty`` an article
    without a kept term has one row of nulls.
    """
    if weighting not in ("tfidf", "binary"):
        raise ValueError(f"unknown weighting: {weighting}")
    rows = matrix.select(
        "docid", "n_lemmas", F.explode_outer(arrays.entries(F.col("tf"))).alias("entry")
    )
    if not keep_empty:
        rows = rows.where(F.col("entry").isNotNull())
    rows = rows.select("docid", "n_lemmas", "entry.*")
    if weighting == "binary":
        return rows.select("docid", "term_id", F.sign("value").alias("weight"))
    idf = vocabulary.table(matrix.sparkSession).select("term_id", "idf")
    weight = F.col("value") / F.col("n_lemmas") * F.col("idf")
    return rows.join(small(idf, len(vocabulary.terms)), "term_id", "left").select(
        "docid", "term_id", weight.alias("weight")
    )
