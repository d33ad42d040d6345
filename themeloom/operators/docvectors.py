"""Article vectors: weighted means of word vectors."""

from collections.abc import Collection, Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions import arrays
from themeloom.operators import cooccurrence, products, skipgram
from themeloom.operators.sizes import small
from themeloom.operators.weights import Vocabulary, weight_rows
from themeloom.plans.staging import staged

# Length of trained vectors and seed.
VECTOR_SIZE = 100
SEED = 0


def train_word_vectors(
    lemmas: DataFrame,
    terms: Collection[str] | None = None,
    vector_size: int = VECTOR_SIZE,
    seed: int = SEED,
    min_count: int = 5,
) -> skipgram.WordVectors:
    """Word vectors of the articles' own lemmas, trained as Spark's Word2Vec does.

    All words are trained, as each learns from those beside it. With
    ``terms``, those of the vocabulary, which are all that is ever looked up,
    the others' vectors are not kept. What is saved is read by Spark's
    ``Word2VecModel.load``.
    """
    tasks = lemmas.sparkSession.sparkContext.defaultParallelism
    wanted = None if terms is None else list(terms)
    table = skipgram.train(lemmas, wanted, vector_size, seed, min_count, tasks)
    params = {
        "vectorSize": vector_size, "minCount": min_count, "seed": seed, "numPartitions": tasks,
        "inputCol": "lemmas", "outputCol": "vec",
    }
    return skipgram.WordVectors(table, params)


def counted_word_vectors(
    lemmas: DataFrame,
    words: Sequence[str],
    vector_size: int = VECTOR_SIZE,
    window: int = cooccurrence.WINDOW,
    shift: float = 1.0,
) -> DataFrame:
    """``word, vector array<double>`` of the listed words, from counts and an SVD.

    What the driver holds follows from the number of words and ``vector_size``,
    and nothing depends on how the articles are split. A word that is never
    near another more often than by chance has no vector.
    """
    counts = cooccurrence.cooccurrences(lemmas, words, window)
    counts = staged(counts, "word-pairs")
    pairs = cooccurrence.positive_pmi(counts, len(words), shift)
    rows = staged(cooccurrence.rows_of(pairs), "word-rows")
    vectors = cooccurrence.factorised(rows, len(words), vector_size)
    named = lemmas.sparkSession.createDataFrame(list(enumerate(words)), "word_id int, word string")
    return vectors.join(small(named, len(words)), "word_id").select("word", "vector")


def vectors_of(model: skipgram.WordVectors) -> DataFrame:
    """``word, vector array<double>`` of a trained model."""
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def vectors_of_terms(vocabulary: Vocabulary, vectors: DataFrame) -> DataFrame:
    """``term_id, vector`` for the terms that have a vector.

    However many word vectors there are, at most one row per term is left,
    and it is the vocabulary that is broadcast to find them.
    """
    terms = vocabulary.table(vectors.sparkSession).select("term_id", F.col("term").alias("word"))
    wanted = vectors.join(small(terms, len(vocabulary.terms)), "word")
    return wanted.select("term_id", arrays.to_doubles(F.col("vector")).alias("vector"))


def article_vectors(
    matrix: DataFrame,
    vocabulary: Vocabulary,
    term_vectors: DataFrame,
    size: int | None = None,
    weighting: str = "tfidf",
) -> DataFrame:
    """``docid, vec array<double>``, zeros where no term has a vector.

    ``size`` is the length of the vectors; when it is not given it is read from
    them, and they must agree. The vectors of the vocabulary's terms are
    multiplied with batches of articles, so nothing is shuffled; vectors too
    many to send to every executor are joined instead.
    """
    if weighting not in ("tfidf", "binary"):
        raise ValueError(f"unknown weighting: {weighting}")
    if size is None:
        length = F.size("vector")
        sizes = term_vectors.agg(F.min(length).alias("least"), F.max(length).alias("most")).first()
        if sizes.least is None:
            raise ValueError("no term has a vector")
        if sizes.least != sizes.most:
            raise ValueError(f"vectors of {sizes.least} to {sizes.most} numbers")
        size = sizes.least
    width = len(vocabulary.terms)
    if not products.fits(width, size + 1):
        return article_vectors_by_join(matrix, vocabulary, term_vectors, size, weighting)
    weights = vocabulary.idfs if weighting == "tfidf" else [1.0] * width
    # The last column adds up the weights of the terms that have a vector.
    dense = np.zeros((width, size + 1))
    for row in term_vectors.collect():
        dense[row.term_id, :size] = row.vector
        dense[row.term_id, size] = 1.0
    dense *= np.array(weights)[:, None]

    def mean(sums: np.ndarray) -> np.ndarray:
        total = sums[:, size:]
        return np.divide(sums[:, :size], total, out=np.zeros((len(sums), size)), where=total > 0)

    # The number of lemmas is in every weight of an article, so it cancels out.
    before = np.sign if weighting == "binary" else None
    return products.times(matrix, dense, "tf", "vec", before=before, after=mean)


def article_vectors_by_join(
    matrix: DataFrame,
    vocabulary: Vocabulary,
    term_vectors: DataFrame,
    size: int,
    weighting: str = "tfidf",
) -> DataFrame:
    """The same for word vectors of any number and length: one row per entry of an article."""
    rows = weight_rows(matrix, vocabulary, weighting, keep_empty=True)
    found = rows.join(term_vectors, "term_id", "left")
    sums = [F.expr(f"sum(weight * get(vector, {i})) AS s{i}") for i in range(size)]
    total = F.sum(F.when(F.col("vector").isNotNull(), F.col("weight"))).alias("total")
    summed = found.groupBy("docid").agg(*sums, total)
    mean = F.expr("array(" + ", ".join(f"s{i} / total" for i in range(size)) + ")")
    return summed.select(
        "docid", F.when(F.col("total") > 0, mean).otherwise(arrays.zeros(size)).alias("vec")
    )
