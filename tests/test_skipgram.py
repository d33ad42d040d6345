"""Word vectors trained by the library, against Spark's model and what training must do."""

import tracemalloc

import numpy as np
import pytest
from pyspark.ml.feature import Word2VecModel

from themeloom.operators import docvectors, skipgram
from themeloom.plans import catalogue


@pytest.fixture(scope="module")
def topics(spark):
    random = np.random.default_rng(0)
    rows = []
    for nth in range(400):
        own, common = random.integers(0, 10, 120), random.integers(0, 5, 120)
        pick = random.random(120) < 0.5
        rows.append(([f"t{nth % 3}_{o}" if p else f"c{c}" for o, c, p in zip(own, common, pick)],))
    return spark.createDataFrame(rows, "lemmas array<string>").repartition(2)


def _vectors(model):
    return {r.word: np.array(r.vector) for r in docvectors.vectors_of(model).collect()}


def test_training_twice_gives_the_same_vectors(topics):
    first, second = (_vectors(docvectors.train_word_vectors(topics, vector_size=8)) for _ in range(2))
    assert first.keys() == second.keys() and len(first) == 35
    assert all((first[word] == second[word]).all() for word in first)


def test_words_of_one_topic_are_near_and_the_model_is_sparks(topics, tmp_path):
    model = docvectors.train_word_vectors(topics, vector_size=20)
    model.save(str(tmp_path / "model"))
    loaded = Word2VecModel.load(str(tmp_path / "model"))
    assert loaded.getVectorSize() == 20
    for word in ("t0_1", "t1_2", "t2_3"):
        near = [r.word for r in loaded.findSynonyms(word, 5).collect()]
        assert {name[:2] for name in near} == {word[:2]}


def test_a_code_leads_to_every_word_and_frequent_ones_have_short_codes():
    counts = [50, 20, 20, 5, 3, 1]
    parent, second = skipgram.huffman(counts)
    nodes, labels, begins = skipgram.paths(parent, second)
    codes = {
        tuple(zip(nodes[i:j].tolist(), labels[i:j].tolist())) for i, j in zip(begins, begins[1:])
    }
    assert len(codes) == len(counts)
    assert (np.diff(begins) * counts).sum() == 4 + 9 + 29 + 49 + 99
    assert sum(0.5 ** n for n in np.diff(begins)) == 1.0


def test_a_word_that_is_half_the_text_does_not_overshoot():
    random = np.random.default_rng(1)
    trainer = skipgram.Trainer(skipgram.huffman([4000, 1000, 1000, 1000, 1000]), 10, 0)
    for _ in range(300):
        ids = np.where(random.random(240) < 0.5, 0, random.integers(1, 5, 240))
        trainer.learn(ids, np.zeros(240, int), np.full(240, 5), 0.5)
    assert np.abs(trainer.inputs).max() < 50 and np.abs(trainer.outputs).max() < 50


def test_a_step_is_the_gradient_of_the_likelihood():
    tree, rate = skipgram.huffman([3, 2, 1]), 1e-3
    trainer = skipgram.Trainer(tree, 4, 0)
    ids, owner = np.array([0, 1, 2, 0, 1]), np.array([0, 0, 0, 1, 1])
    trainer.learn(ids, owner, np.ones(5, int), 0.0)
    trainer.outputs[:] = np.random.default_rng(2).standard_normal(trainer.outputs.shape)
    was, outputs = trainer.inputs.copy().astype(float), trainer.outputs.copy().astype(float)
    wanted = np.zeros_like(was)
    for word, context in [(0, 1), (1, 0), (1, 2), (2, 1), (0, 1), (1, 0)]:
        for at in range(trainer.begins[word], trainer.begins[word + 1]):
            node = outputs[trainer.nodes[at]]
            wanted[context] += (trainer.labels[at] - 1 / (1 + np.exp(-was[context] @ node))) * node
    trainer.learn(ids, owner, np.ones(5, int), rate)
    assert np.allclose((trainer.inputs - was) / rate, wanted, rtol=2e-2, atol=2e-3)


def test_no_word_often_enough_is_an_error(spark):
    rare = spark.createDataFrame([(["a", "b", None],), (None,), ([],)], "lemmas array<string>")
    with pytest.raises(ValueError, match="no word"):
        docvectors.train_word_vectors(rare)
    lone = docvectors.train_word_vectors(rare, vector_size=3, min_count=1)
    assert _vectors(lone).keys() == {"a", "b"}


def test_a_task_holds_no_more_vectors_however_many_words_there_are():
    n = 400_000
    tree = skipgram.huffman(list(range(2 * n, n, -1)))
    tracemalloc.start()
    trainer = skipgram.Trainer(tree, 100, 0)
    # Each word is there once, beside its neighbours.
    for ids in np.split(np.arange(n), 100)[::10]:
        trainer.learn(ids, np.zeros(len(ids), int), np.ones(len(ids), int), 0.025)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert trainer.met.sum() == n // 10 and peak < 800 * n / 2


def test_vectors_in_files_are_those_in_memory():
    tree = skipgram.huffman(list(range(300, 0, -1)))
    whole, cut = skipgram.Trainer(tree, 6, 0), skipgram.Trainer(tree, 6, 0, held=7)
    random = np.random.default_rng(3)
    for _ in range(20):
        # Some words are never met, some only by themselves.
        ids = np.minimum(random.geometric(0.02, 200), 290)
        owner = np.sort(random.integers(0, 90, 200))
        reach = random.integers(1, 6, 200)
        for trainer in (whole, cut):
            trainer.learn(ids, owner, reach, 0.1)
    met = np.flatnonzero(whole.met)
    assert (whole.met == cut.met).all() and len(met) > 100 and met[-1] > 200
    assert len(cut.inputs) == len(cut.outputs) == 7 and cut.rare_inputs.n > 90
    assert (whole.vectors_of(met) == cut.vectors_of(met)).all()
    assert np.abs(whole.vectors_of(met) - skipgram.first_vectors(met, 6, 0)).max() > 0.01


def test_the_vectors_of_some_terms_are_those_that_all_words_give(topics):
    every = _vectors(docvectors.train_word_vectors(topics, vector_size=8))
    some = _vectors(docvectors.train_word_vectors(topics, ["t0_1", "nowhere", "c3"], vector_size=8))
    assert some.keys() == {"t0_1", "c3"}
    assert all((some[word] == every[word]).all() for word in some)
    with pytest.raises(ValueError, match="no word"):
        docvectors.train_word_vectors(topics, ["nowhere"])


def test_articles_vectors_come_from_words_that_learn_from_all_words(spark, tmp_path, monkeypatch):
    letters, random = "abcdefghij", np.random.default_rng(4)
    listed = np.array(["q" + "".join(letters[int(d)] for d in f"{i:04d}") for i in range(1300)])
    texts = [" ".join(listed[random.permutation(1300 - 60 * (i % 9))[:400]]) for i in range(60)]
    rows = [(i, text, "en", "s", len(text)) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    trained, train = [], docvectors.train_word_vectors

    def watched(lemmas, *more):
        trained.append((lemmas, train(lemmas, *more)))
        return trained[-1][1]

    monkeypatch.setattr(docvectors, "train_word_vectors", watched)
    vecs = {r.docid: r.vec for r in catalogue.doc_vectors_trained(spark, str(tmp_path)).collect()}
    ((lemmas, model),) = trained
    own, every = _vectors(model), _vectors(train(lemmas))
    assert 900 < len(own) <= 1000 < 1200 < len(every) and len(vecs) == 60
    assert all((own[word] == every[word]).all() for word in own)
