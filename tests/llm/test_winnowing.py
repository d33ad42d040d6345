import pytest
from pyspark.sql import functions as F

from themeloom.llm import winnowing as w

GRAM, WINDOW = 1 << w.GRAM_STEPS, 1 << w.WINDOW_STEPS


def by_windows(grams):
    """Places of what winnowing keeps: smallest of each window, rightmost of equals."""
    if not grams:
        return []
    kept = []
    for begin in range(max(1, len(grams) - WINDOW + 1)):
        part = grams[begin : begin + WINDOW]
        at = begin + max(i for i, g in enumerate(part) if g == min(part))
        if at not in kept:
            kept.append(at)
    return kept


def grams_of(words, hash_of):
    if not words:
        return []
    if len(words) < GRAM:
        return None
    return [hash_of[tuple(words[i : i + GRAM])] for i in range(len(words) - GRAM + 1)]


@pytest.fixture(scope="module")
def made(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    made = w.fingerprint_documents(docs).withColumn("shown", w.as_text(F.col("kept")))
    rows = made.join(docs.select("doc_id", "text"), "doc_id").collect()
    return sorted(rows, key=lambda r: -r.doc_id)


def gram_hashes(spark, rows):
    """Hashes of single grams, made by fingerprinting them as texts of their own."""
    grams = {
        tuple(words[i : i + GRAM])
        for words in (r.text.lower().split() for r in rows)
        for i in range(len(words) - GRAM + 1)
    }
    table = spark.createDataFrame([(" ".join(g),) for g in grams], "text string")
    found = w.with_selection(table, "text", "kept").select("text", w.hashes_of(F.col("kept")))
    return {tuple(r[0].split(" ")): r[1][0] for r in found.collect()}


def test_kept_are_the_rightmost_minima_of_all_windows(spark, made):
    rows = made[:40]
    hash_of = gram_hashes(spark, rows)
    for row in rows:
        grams = grams_of(row.text.lower().split(), hash_of)
        if grams is None:
            assert len(row.kept) == 1
            continue
        at = by_windows(grams)
        assert [s >> 31 for s in row.kept] == [grams[i] for i in at]
        assert [w.LAST - (s & w.LAST) for s in row.kept] == at


def test_edited_text_and_neighbours(made):
    for i, row in enumerate(made):
        following = made[(i + 1) % len(made)].text
        third = len(row.text) // 3
        assert row.edited == row.text[: len(row.text) - third] + following[:third]
        assert row.next_kept == made[(i + 1) % len(made)].kept
    assert len({(r.text, r.shown) for r in made}) == len({r.text for r in made})


def test_many_chunks_give_the_same_neighbours(spark, made, tables, monkeypatch):
    monkeypatch.setattr(w, "CHUNK_ROWS", 7)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: (r.edited, r.next_kept) for r in w.fingerprint_documents(docs).collect()}
    assert got == {r.doc_id: (r.edited, r.next_kept) for r in made}


def test_equal_hashes_keep_the_rightmost(spark):
    table = spark.createDataFrame([("x " * 40,)], "text string")
    kept = w.with_selection(table, "text", "kept").first().kept
    # All grams are equal: each window keeps its last one.
    assert [w.LAST - (s & w.LAST) for s in kept] == list(range(WINDOW - 1, 40 - GRAM + 1))


def test_a_shared_run_shares_a_hash(spark):
    run = " ".join(f"w{i}" for i in range(GRAM + WINDOW - 1))
    rows = [("a b c d e " + run + " f g",), ("h i " + run + " j k l m n o p",)]
    table = w.with_selection(spark.createDataFrame(rows, "text string"), "text", "kept")
    a, b = (set(r[0]) for r in table.select(w.hashes_of(F.col("kept"))).collect())
    assert a & b


def test_edge_rows(spark):
    rows = [(5, None, 1), (None, "q r", 1), (5, None, 1), (3, "", 2), (2, " \n", 0), (None, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    made = w.fingerprint_documents(docs)
    assert made.count() == 6
    by_text = {(r.doc_id, r.n_chars): r for r in made.collect()}
    assert by_text[(None, 3)].next_kept == by_text[(None, 1)].kept
    assert by_text[(None, 3)].edited == "q " + "z"
    assert by_text[(5, 0)].kept == [] and len(by_text[(None, 3)].kept) == 1
    assert w.fingerprint_documents(docs.limit(0)).collect() == []
    alone = w.fingerprint_documents(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string"))
    assert alone.first().edited == "abcdab"
    like = alone.select(w.likeness(F.array(), F.array()).alias("x")).first().x
    assert like == 1.0


def test_the_plan_has_no_python(spark, tables):
    plan = w.op10_winnowing(spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
