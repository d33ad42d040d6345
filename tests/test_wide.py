"""Wide matrices, heavy terms and word vectors from counts, against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from themeloom.operators import cooccurrence, docvectors, heavy, matrix, weights, wide


def _sparse(spark, rows, parts):
    made = []
    for i, row in enumerate(rows):
        at = np.flatnonzero(row)
        made.append((i, Vectors.sparse(len(row), at.tolist(), row[at].tolist())))
    return spark.createDataFrame(made, ["docid", "features"]).repartition(parts)


def test_wide_matrix_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = rng.random((120, 5000)) * (rng.random((120, 5000)) < 0.02) * rng.geometric(0.5, 5000)
    svd = matrix.truncated_svd(_sparse(spark, rows, 5), 5000, 6, "randomised")
    _, values, basis = np.linalg.svd(rows, full_matrices=False)
    assert svd.residual <= wide.TOLERANCE
    assert np.allclose(svd.values, values[:6], rtol=1e-9)
    assert np.allclose(svd.basis, matrix.orient(basis[:6].T), atol=1e-6)


def test_low_rank_and_empty_matrices(spark):
    rows = np.zeros((6, 40))
    rows[0, 3], rows[2, [5, 7]] = 2.0, 1.0
    svd = matrix.truncated_svd(_sparse(spark, rows, 3), 40, 5, "randomised")
    assert np.allclose(svd.values, [2.0, math.sqrt(2)]) and svd.basis.shape == (40, 2)
    nothing = _sparse(spark, np.zeros((3, 40)), 2)
    assert len(matrix.truncated_svd(nothing, 40, 5, "randomised").values) == 0
    assert len(matrix.truncated_svd(nothing.where("false"), 40, 5, "randomised").values) == 0


def test_a_matrix_beyond_the_driver_is_refused(spark):
    with pytest.raises(ValueError, match="too many"):
        wide.leading_eigenvectors(_sparse(spark, np.zeros((1, 2)), 1), 10_000_000, 10)


def test_passes_do_not_make_the_rows_again(spark):
    rng = np.random.default_rng(4)
    rows = rng.random((40, 60)) * (rng.random((40, 60)) < 0.3)
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    table = _sparse(spark, rows, 3)
    table = table.select("docid", "features").mapInArrow(counted, table.schema)
    values, _, _ = wide.leading_eigenvectors(table, 60, 3)
    assert np.allclose(np.sqrt(values), np.linalg.svd(rows)[1][:3]) and made.value == 40


def test_pass_over_rows_in_small_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.5)
    at, lengths, values = np.nonzero(rows)[1], (rows != 0).sum(axis=1), rows[rows != 0]
    block, total = rng.normal(size=(30, 3)), np.zeros((12, 3))
    monkeypatch.setattr("themeloom.operators.products.AT_ONCE", 10)
    wide.add_by_column(at, values, lengths, block, total)
    assert np.allclose(total, rows.T @ block)


def _lemma_rows(spark, lists, parts=4):
    table = spark.createDataFrame(list(enumerate(lists)), "docid int, lemmas array<string>")
    return table.repartition(parts, "docid")


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(3)
    return [
        [f"w{min(int(x), 4000)}" for x in rng.zipf(1.3, rng.integers(0, 60))] for _ in range(300)
    ]


@pytest.mark.parametrize("counters", [3, 40, 150, 10_000])
def test_heavy_terms_equal_the_full_count(spark, crowd, counters):
    lemmas = _lemma_rows(spark, crowd)
    counted = Counter(term for words in crowd for term in set(words))
    want = sorted(counted.items(), key=lambda pair: (-pair[1], pair[0]))[:20]
    assert heavy.most_frequent(lemmas, 20, counters) == (300, want)
    assert weights.build_vocabulary(lemmas, 20, counters) == weights.build_vocabulary(lemmas, 20)


def test_bounded_counters_shuffle_fewer_rows(spark, crowd):
    lemmas = _lemma_rows(spark, crowd)
    few, all_terms = heavy.summaries(lemmas, 40), heavy.summaries(lemmas, 10_000)
    lost = few.where("term IS NULL").first().lost
    assert lost > 0 and few.count() <= 4 * 40 + 1 < all_terms.count()
    counted = Counter(term for words in crowd for term in set(words))
    for row in few.where("term IS NOT NULL").collect():
        assert counted[row.term] - lost <= row.n <= counted[row.term]


def test_heavy_terms_of_odd_tables(spark):
    odd = _lemma_rows(spark, [None, [], ["a", None, "a"], ["b"], ["b", "a"]])
    assert heavy.most_frequent(odd, 5, 1) == (5, [("a", 2), ("b", 2)])
    assert heavy.most_frequent(odd.where("false"), 5, 1) == (0, [])
    with pytest.raises(ValueError, match="no article"):
        weights.build_vocabulary(odd.where("docid < 2"), 5, 1)


def _counted(lists, words, window):
    found = Counter()
    for own in lists:
        for i, a in enumerate(own or []):
            for b in own[max(i - window, 0) : i] + own[i + 1 : i + 1 + window]:
                if a in words and b in words:
                    found[words.index(a), words.index(b)] += 1
    return found


def test_pairs_against_brute_force(spark, crowd):
    words = [f"w{i}" for i in range(1, 40)]
    lists = [*crowd[:60], None, [], ["w1"], ["w2", None, "w2", "w3"]]
    got = cooccurrence.cooccurrences(_lemma_rows(spark, lists), words, 3)
    assert {(r.word_id, r.context_id): r.n for r in got.collect()} == _counted(lists, words, 3)
    assert cooccurrence.cooccurrences(_lemma_rows(spark, lists), [], 3).count() == 0
    with pytest.raises(ValueError, match="twice"):
        cooccurrence.cooccurrences(_lemma_rows(spark, lists), ["a", "a"])


def test_word_vectors_are_those_of_numpy_on_any_split(spark, crowd):
    words = [f"w{i}" for i in range(1, 40)]
    counts = np.zeros((39, 39))
    for (a, b), n in _counted(crowd, words, 5).items():
        counts[a, b] = n
    with np.errstate(divide="ignore"):
        pmi = np.log(counts * counts.sum() / np.outer(counts.sum(1), counts.sum(0)))
    left, values, _ = np.linalg.svd(np.maximum(pmi, 0.0))
    want = left[:, :4] * np.sqrt(values[:4])
    for parts in (1, 7):
        made = docvectors.counted_word_vectors(_lemma_rows(spark, crowd, parts), words, 4)
        got = {r.word: r.vector for r in made.collect()}
        have = np.array([got.get(word, [0.0] * 4) for word in words])
        assert np.allclose(have @ have.T, want @ want.T, atol=1e-4)
        assert np.allclose(np.abs(have), np.abs(want), atol=1e-3)
