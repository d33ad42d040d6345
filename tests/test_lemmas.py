import re

import pytest
from pyspark.sql import functions as F

from themeloom.functions import tokens
from themeloom.operators import lemmas as L

TEXTS = [
    (1, "The cats were RUNNING; the cat ran. r2d2 and snake_case, Élan vital!"),
    (2, "ran ran runs to me"),
    (3, ""),
    (4, None),
    (5, "42 _ is it"),
]
LEMMA_OF = {"cats": "cat", "ran": "run", "running": "run", "runs": "run", "were": "be"}


@pytest.fixture
def articles(spark):
    return spark.createDataFrame(TEXTS, "docid int, text string").withColumn(
        "date", F.lit("2016-01-01").cast("date")
    )


def _got(table):
    return {r.docid: list(r.lemmas) for r in table.collect()}


EXPECTED = {
    1: ["cat", "run", "cat", "run", "lan", "vital"],
    2: ["run", "run", "run"],
    3: [],
    4: [],
    5: [],
}


def test_lemmas_in_text_order(articles):
    out = L.lemmatise(articles, LEMMA_OF, ["the", "and"])
    assert out.columns == ["docid", "date", "lemmas"]
    assert _got(out) == EXPECTED


def test_word_lists_as_tables(spark, articles):
    table = spark.createDataFrame(list(LEMMA_OF.items()), "form string, lemma string")
    stops = spark.createDataFrame([("the",), ("and",), ("the",)], "word string")
    assert _got(L.lemmatise(articles, table, stops)) == EXPECTED


def _tables(spark):
    table = spark.createDataFrame([*LEMMA_OF.items(), (None, "x"), ("y", None)], "form string, lemma string")
    return table, spark.createDataFrame([("the",), ("and",), ("the",), (None,)], "word string")


def test_lists_too_long_to_send_are_joined(spark, articles, monkeypatch):
    monkeypatch.setattr(L, "MOST_FORMS", 2)
    assert L.word_lists(LEMMA_OF, []) is None
    for lists in ((LEMMA_OF, ["the", "and"]), _tables(spark)):
        out = L.lemmatise(articles, *lists)
        assert _got(out) == EXPECTED and set(out.columns) == {"docid", "date", "lemmas"}
    monkeypatch.setattr(L, "MOST_FORMS", 100)
    monkeypatch.setattr(L, "LONGEST_FORM", 3)
    assert L.word_lists(*_tables(spark)) is None


def test_forty_thousand_forms_without_a_shuffle(spark):
    forms = [(f"{a}{b}{c}{d}", f"{a}{b}{c}") for a in "bcdfghjklmnpqrst" for b in "aeiou"
             for c in "bcdfghjklmnpqrstvwxyz" for d in "bcdfghjklmnpqrstvwxyzaeio"]
    assert len(forms) > 40_000
    table = spark.createDataFrame(forms, "form string, lemma string")
    texts = spark.createDataFrame([(i, f"{a} other {b}") for i, (a, b) in enumerate(zip(*[[f for f, _ in forms[i::2]] for i in (0, 1)]))], "docid int, text string")
    out = L.lemmatise(texts, table, ["other"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert all(r.lemmas == [forms[2 * r.docid][1], forms[2 * r.docid + 1][1]] for r in out.collect())


def test_repeated_ids_stay_apart(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "cats ran"), (1, "dogs"), (1, "dogs"), (None, None)], "docid int, text string")
    wanted = sorted([(1, ["cat", "run"]), (1, ["dogs"]), (1, ["dogs"]), (0, [])])
    for most in (100, 1):
        monkeypatch.setattr(L, "MOST_FORMS", most)
        found = L.lemmatise(texts, LEMMA_OF, []).collect()
        assert sorted((r.docid or 0, r.lemmas) for r in found) == wanted


def test_two_lemmas_for_a_form_are_an_error(spark, articles, monkeypatch):
    table = spark.createDataFrame([("cats", "cat"), ("cats", "dog"), ("ran", "run")], "form string, lemma string")
    for most in (100, 1):
        monkeypatch.setattr(L, "MOST_FORMS", most)
        with pytest.raises(ValueError, match="cats"):
            L.lemmatise(articles, table, [])


def test_joined_lists_agree_on_the_given_texts(spark, tables):
    from themeloom.plans.catalogue import LEMMAS, STOP_WORDS, _articles

    texts = _articles(spark, tables).select("docid", "text")
    sent = L.lemmatise(texts, LEMMAS, STOP_WORDS)
    joined = L.lemmatise_by_join(texts, LEMMAS, STOP_WORDS)
    both = sent.alias("a").join(joined.alias("b"), "docid")
    assert both.where(F.col("a.lemmas") == F.col("b.lemmas")).count() == texts.count()


@pytest.mark.parametrize("lemma_of", [LEMMA_OF, LEMMA_OF | {"me": "myself", "r2d2": "robot"}, {}])
@pytest.mark.parametrize("stops", [[], ["run", "me"], ["were", "cats", "myself"]])
def test_as_word_by_word(articles, lemma_of, stops):
    def by_hand(text):
        found = [lemma_of.get(form, form) for form in re.split(r"\W+", (text or "").lower(), flags=re.ASCII)]
        return [w for w in found if re.fullmatch("[a-z]{3,}", w) and w not in stops]

    assert _got(L.lemmatise(articles, lemma_of, stops)) == {i: by_hand(text) for i, text in TEXTS}


def test_short_form_with_a_long_lemma(articles):
    out = _got(L.lemmatise(articles, {"me": "myself", "r2d2": "robot"}, []))
    assert out[2] == ["ran", "ran", "runs", "myself"] and "robot" in out[1]


def test_python_lemmatiser_is_set_up_per_partition(articles):
    def make():
        ready = str.upper

        def lemmatise(text):
            return [w.rstrip("s") for w in ready(text).lower().split(" ")]

        return lemmatise

    out = L.lemmatise_with(articles.repartition(2, "docid"), make, ["the"])
    assert out.columns == ["docid", "date", "lemmas"]
    assert _got(out)[2] == ["ran", "ran", "run"]
    assert _got(out)[4] == []


def test_distinct(articles):
    rows = L.distinct_lemmas(L.lemmatise(articles, LEMMA_OF, ["the", "and"]))
    assert sorted(tuple(r) for r in rows.collect()) == [
        (1, "cat"), (1, "lan"), (1, "run"), (1, "vital"), (2, "run"),
    ]


def test_plain_text(spark):
    table = spark.createDataFrame([("Élan, the END.",)], "t string")
    assert table.select(tokens.plain_text(F.col("t"))).first()[0] == " lan the end "


def test_longer_lists_are_joined_with_the_words_of_blocks(spark, monkeypatch):
    from themeloom.plans.staging import staged

    texts = spark.createDataFrame([(i, "cats ran while others ran " * 400) for i in range(60)], "docid int, text string")
    texts = staged(texts.repartition(2), "texts")
    table = spark.createDataFrame(list(LEMMA_OF.items()) * 2, "form string, lemma string")
    monkeypatch.setattr(L, "MOST_FORMS", 1)
    out = L.lemmatise(texts, table, ["while"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "text#" not in plan
    assert [r.lemmas for r in out.collect()] == [["cat", "run", "others", "run"] * 400] * 60
    blocks = L._in_blocks(texts, ["docid"], L.tokens.kept_words(F.col("text")))
    listed = blocks.where("words is not null")
    assert listed.selectExpr("sum(size(words))").first()[0] <= 4 * blocks.select("block").distinct().count() < 60


def test_pieces_of_batches():
    import pyarrow as pa

    from themeloom.operators.batches import in_pieces

    batch = pa.RecordBatch.from_pydict({"a": list(range(1000)), "b": [["x" * 10] * 5] * 1000})
    pieces = list(in_pieces([batch, batch.slice(0, 0), batch.slice(0, 1)], 4000))
    assert max(piece.nbytes for piece in pieces) <= 4100 and len(pieces) > 10
    assert pa.Table.from_batches(pieces).to_pydict()["a"] == [*range(1000), 0]
    assert [piece.num_rows for piece in in_pieces([batch], 1)] == [1] * 1000
