"""The two ways to themes, and their comparison."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from themeloom import sinks
from themeloom.operators import clusters, compare, docvectors, matrix, reduce
from themeloom.operators.lemmas import LemmaTable, WordList, lemmatise
from themeloom.operators.weights import (
    NUM_TERMS,
    Vocabulary,
    build_vocabulary,
    term_matrix,
    weight_vectors,
)
from themeloom.plans.staging import staged
from themeloom.sources.articles import spread
from themeloom.sources.word_lists import IRREGULAR_LEMMAS


@dataclass(frozen=True)
class Terms:
    """What both ways start from."""

    vocabulary: Vocabulary
    matrix: DataFrame

    @property
    def table(self) -> DataFrame:
        return self.vocabulary.table(self.matrix.sparkSession)

    def weighted(self) -> DataFrame:
        return weight_vectors(self.matrix, self.vocabulary)


@dataclass(frozen=True)
class Way:
    """Results of one way: ``projection`` and ``labels`` are keyed by docid.

    ``labels`` is ``docid, date, cluster`` without an order.
    """

    projection: DataFrame
    themes: clusters.Themes
    labels: DataFrame


def prepare(
    articles: DataFrame,
    lemma_of: LemmaTable = IRREGULAR_LEMMAS,
    stop_words: WordList = (),
    num_terms: int = NUM_TERMS,
    body: str = "text",
    stage: bool = True,
) -> Terms:
    """From ``docid, text`` (and ``date``) to the term matrix.

    The texts are passed over twice, once for the vocabulary and once for the
    matrix. Cutting a text into lemmas costs about as much as writing the
    lemmas out and reading them twice, so they are not kept.
    """
    carried = [c for c in ("docid", "date") if c in articles.columns]
    texts = spread(articles.select(*carried, body))
    return prepare_lemmas(lemmatise(texts, lemma_of, stop_words, body), num_terms, stage)


def prepare_lemmas(lemmas: DataFrame, num_terms: int = NUM_TERMS, stage: bool = True) -> Terms:
    """The same from lemmas; stage those first if they were costly to make.

    Leave the matrix unstaged where it is read only once.
    """
    vocabulary = build_vocabulary(lemmas, num_terms)
    counts = term_matrix(lemmas, vocabulary)
    return Terms(vocabulary, staged(counts, "term-matrix") if stage else counts)


def lsa_projection(
    terms: Terms, k: int = matrix.RANK, solver: str = "gram"
) -> tuple[matrix.TruncatedSVD, DataFrame]:
    """SVD of the weights, and ``docid, projection``."""
    width = len(terms.vocabulary.terms)
    svd = matrix.truncated_svd(terms.weighted(), width, k, solver)
    basis = matrix.basis_table(terms.matrix.sparkSession, svd.basis)
    return svd, matrix.project(terms.weighted(), basis, width, len(svd.values))


def lsa_way(
    terms: Terms,
    rank: int = matrix.RANK,
    k: int = clusters.CLUSTERS,
    on: str = "full",
    runs: int = 1,
    normalise: bool = False,
) -> Way:
    """Themes from TF-IDF weights; ``on="reduced"`` clusters the projection."""
    _, projection = lsa_projection(terms, rank)
    weighted = terms.weighted()
    return _way(terms, projection, weighted, on, k, runs, normalise)


def vectors_of_articles(
    terms: Terms, vectors: DataFrame, size: int | None = None, weighting: str = "tfidf"
) -> DataFrame:
    """Staged ``docid, vec`` from a table ``word, vector``."""
    of_terms = docvectors.vectors_of_terms(terms.vocabulary, vectors)
    vecs = docvectors.article_vectors(terms.matrix, terms.vocabulary, of_terms, size, weighting)
    return staged(vecs, "article-vectors")


def pca_projection(
    vecs: DataFrame, k: int = matrix.RANK
) -> tuple[reduce.PrincipalComponents, DataFrame]:
    """Principal components of standardised vectors, and ``docid, projection``."""
    standardised = reduce.standardise(vecs)
    components = reduce.principal_components(standardised, k)
    return components, components.project(standardised)


def word_vector_way(
    terms: Terms,
    vecs: DataFrame,
    rank: int = matrix.RANK,
    k: int = clusters.CLUSTERS,
    on: str = "full",
    runs: int = 1,
    normalise: bool = False,
) -> Way:
    """Themes from article vectors; ``on="reduced"`` clusters the components."""
    _, projection = pca_projection(vecs, rank)
    features = vecs.select("docid", matrix.as_features("vec").alias("features"))
    return _way(terms, projection, features, on, k, runs, normalise)


def _way(
    terms: Terms,
    projection: DataFrame,
    features: DataFrame,
    on: str,
    k: int,
    runs: int,
    normalise: bool,
) -> Way:
    if on not in ("full", "reduced"):
        raise ValueError(f"cannot cluster on: {on}")
    if on == "reduced":
        # Read for the fit, for the labels and for the output.
        projection = staged(projection, "projection")
        features = projection.select("docid", matrix.as_features("projection").alias("features"))
    themes = clusters.fit_themes(features, k=k, runs=runs, normalise=normalise)
    rows = clusters.unit_length(features, "features") if normalise else features
    labels = themes.assign(rows)
    if "date" in terms.matrix.columns and "date" not in labels.columns:
        labels = labels.join(terms.matrix.select("docid", "date"), "docid")
    return Way(projection, themes, staged(labels, "labels"))


def nearest_of(themes: clusters.Themes, vecs: DataFrame, n: int = clusters.NEAREST_ARTICLES):
    """Articles nearest to each centre of a fitted model."""
    centres = themes.centres(vecs.sparkSession)
    distances = clusters.squared_distances(vecs, centres, range(len(themes.matrix)))
    return clusters.nearest_articles(distances, n)


def save_all(
    terms: Terms, lsa: Way, word_vectors: Way, vecs: DataFrame, folder: str
) -> None:
    """All outputs of both ways, as text and as parquet keyed by docid."""
    sinks.write_term_index(terms.table, f"{folder}/term_index")
    sinks.write_vectors(vecs, "vec", f"{folder}/article_vectors")
    sinks.write_table(vecs, f"{folder}/article_vectors.parquet")
    for name, way in (("lsa", lsa), ("word_vectors", word_vectors)):
        projection = staged(way.projection, f"{name}-projection")
        sinks.write_vectors(projection, "projection", f"{folder}/{name}_projection")
        sinks.write_table(projection, f"{folder}/{name}_projection.parquet")
        sinks.write_labels(way.labels, f"{folder}/{name}_labels")
        sinks.write_labelled(clusters.by_date(way.labels), f"{folder}/{name}_labelled_by_date")
        sinks.write_table(way.labels, f"{folder}/{name}_labels.parquet")


def compare_ways(lsa: Way, word_vectors: Way) -> DataFrame:
    """``cluster_a`` of the first way against ``cluster_b`` of the second."""
    return compare.contingency(lsa.labels, word_vectors.labels)
