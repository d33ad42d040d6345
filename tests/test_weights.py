import math

import pytest
from pyspark.sql import functions as F

from themeloom.functions import arrays
from themeloom.operators import docvectors, matrix
from themeloom.operators import weights as Wt
from themeloom.operators.lemmas import lemmatise


def _lemmas(spark, *texts):
    rows = list(enumerate(texts))
    return lemmatise(spark.createDataFrame(rows, "docid int, text string"), {}, [])


@pytest.fixture
def known(three):
    lemmas = lemmatise(three, {}, [])
    vocabulary = Wt.build_vocabulary(lemmas)
    return lemmas, vocabulary, Wt.term_matrix(lemmas, vocabulary)


def test_known_weights(spark, known):
    _, vocabulary, counts = known
    named = Wt.weight_rows(counts, vocabulary).join(vocabulary.table(spark), "term_id")
    got = {(r.docid, r.term): round(r.weight, 6) for r in named.collect()}
    assert got == {
        (1, "cats"): 0.135155, (1, "chase"): 0.366204, (1, "mice"): 0.366204,
        (2, "cats"): 0.202733, (2, "sleep"): 0.549306,
    }


def test_articles_without_terms_stay(known):
    lemmas, vocabulary, counts = known
    assert vocabulary.n_docs == 3
    assert {r.docid for r in counts.collect()} == {1, 2, 3}
    rows = Wt.weight_rows(counts, vocabulary, keep_empty=True)
    assert [(r.term_id, r.weight) for r in rows.where("docid = 3").collect()] == [(None, None)]
    assert {r.docid: r.n_lemmas for r in Wt.kept_in_article(lemmas).collect()} == {1: 3, 2: 2, 3: 0}


def test_vector_form_agrees_with_long_form(known):
    _, vocabulary, counts = known
    entries = arrays.entries(F.col("features"))
    vectors = Wt.weight_vectors(counts, vocabulary)
    got = {
        (r.docid, r.e.term_id): round(r.e.value, 9)
        for r in vectors.select("docid", F.explode(entries).alias("e")).collect()
    }
    rows = Wt.weight_rows(counts, vocabulary).collect()
    assert got == {(r.docid, r.term_id): round(r.weight, 9) for r in rows}
    assert {r.docid for r in vectors.collect()} == {1, 2, 3}


def test_rank_is_by_articles_not_by_occurrences(spark):
    lemmas = _lemmas(spark, "aaa aaa aaa aaa aaa", "bbb", "bbb")
    assert Wt.build_vocabulary(lemmas, 1).terms == ["bbb"]


def test_ties_are_ordered_by_term(spark):
    vocabulary = Wt.build_vocabulary(_lemmas(spark, "delta alpha", "gamma beta alpha"), 3)
    assert vocabulary.terms == ["alpha", "beta", "delta"]
    assert vocabulary.dfs == [2, 1, 1]
    assert vocabulary.idfs == [0.0, math.log(2), math.log(2)]


def test_denominator_counts_words_outside_the_vocabulary(spark):
    lemmas = _lemmas(spark, "aaa bbb ccc ddd", "aaa", "zzz")
    vocabulary = Wt.build_vocabulary(lemmas, 1)
    rows = Wt.weight_rows(Wt.term_matrix(lemmas, vocabulary), vocabulary)
    got = {r.docid: r.weight for r in rows.collect()}
    assert got == {0: pytest.approx(math.log(1.5) / 4), 1: pytest.approx(math.log(1.5))}


def test_no_words_at_all(spark):
    with pytest.raises(ValueError):
        Wt.build_vocabulary(_lemmas(spark, "", "12"))


def test_term_frequency_counts_runs(spark):
    lemmas = _lemmas(spark, "bbb aaa bbb ccc bbb", "", "aaa")
    got = {tuple(r) for r in Wt.term_frequency(lemmas).collect()}
    assert got == {(0, "aaa", 1), (0, "bbb", 3), (0, "ccc", 1), (2, "aaa", 1)}
    df = {tuple(r) for r in Wt.document_frequency(lemmas).collect()}
    assert df == {("aaa", 2), ("bbb", 1), ("ccc", 1)}


@pytest.mark.parametrize(
    ("weighting", "first"), [("tfidf", [0.269577, 0.730423]), ("binary", [0.5, 0.5])]
)
def test_known_article_vectors(spark, known, weighting, first):
    _, vocabulary, counts = known
    vectors = spark.createDataFrame(
        [("cats", [1.0, 0.0]), ("chase", [0.0, 1.0]), ("dogs", [9.0, 9.0])],
        "word string, vector array<float>",
    )
    of_terms = docvectors.vectors_of_terms(vocabulary, vectors)
    vecs = docvectors.article_vectors(counts, vocabulary, of_terms, weighting=weighting)
    got = {r.docid: [round(x, 6) for x in r.vec] for r in vecs.collect()}
    assert got == {1: first, 2: [1.0, 0.0], 3: [0.0, 0.0]}
    assert {r.docid for r in matrix.nonzero_rows(vecs).collect()} == {1, 2}


def test_binary_weight_of_a_term_in_every_article(spark):
    lemmas = _lemmas(spark, "aaa", "aaa bbb", "aaa")
    vocabulary = Wt.build_vocabulary(lemmas)
    counts = Wt.term_matrix(lemmas, vocabulary)
    vectors = spark.createDataFrame([("aaa", [1.0]), ("bbb", [3.0])], "word string, vector array<float>")
    of_terms = docvectors.vectors_of_terms(vocabulary, vectors)
    binary = docvectors.article_vectors(counts, vocabulary, of_terms, 1, "binary")
    assert {r.docid: r.vec[0] for r in binary.collect()} == {0: 1.0, 1: 2.0, 2: 1.0}
    # Its TF-IDF weight is 0, so an article of nothing else has no direction.
    tfidf = docvectors.article_vectors(counts, vocabulary, of_terms, 1)
    assert {r.docid: r.vec[0] for r in tfidf.collect()} == {0: 0.0, 1: 3.0, 2: 0.0}


def test_unknown_weighting(known):
    _, vocabulary, counts = known
    with pytest.raises(ValueError):
        Wt.weight_rows(counts, vocabulary, "count")


def test_weights_do_not_depend_on_partitions(spark, tables):
    from themeloom.plans.catalogue import LEMMAS, STOP_WORDS, _articles

    def weights(n):
        lemmas = lemmatise(_articles(spark, tables).repartition(n), LEMMAS, STOP_WORDS)
        vocabulary = Wt.build_vocabulary(lemmas, 200)
        rows = Wt.weight_rows(Wt.term_matrix(lemmas, vocabulary), vocabulary)
        return vocabulary.terms, sorted(rows.collect())

    assert weights(1) == weights(13)
