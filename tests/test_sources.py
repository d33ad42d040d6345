import datetime as dt
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom import schemas, sinks
from themeloom.functions import fields
from themeloom.operators import docvectors, explore, records
from themeloom.sources import articles, words

XML = """<root>
<document><docid>1</docid><title>A</title><text>Hello &amp; bye</text><date>2016-06-01 10:00:00</date></document>
<document><docid>x</docid><title>B</title><text></text><date></date></document>
<document><docid>3</docid><title>B</title><text>zz <b>bold</b> tail</text><date>2016-07-01</date></document>
</root>
"""


@pytest.fixture
def xml(tmp_path):
    path = tmp_path / "articles.xml"
    path.write_text(XML)
    return str(path)


def test_xml_records(spark, xml):
    raw = articles.read_xml(spark, xml)
    assert raw.columns == schemas.DECLARED_ARTICLE.names
    rows = raw.select("docid", fields.date_field("date").alias("date"), fields.string_field("text").alias("t"))
    got = [tuple(r) for r in rows.collect()]
    assert got == [
        ("1", dt.datetime(2016, 6, 1), "Hello & bye"),
        ("x", None, ""),
        ("3", dt.datetime(2016, 7, 1), "zz bold tail"),
    ]


def test_bad_id_fails_or_is_left_out(spark, xml):
    raw = articles.read_xml(spark, xml)
    lenient = records.article_records(raw, strict=False)
    assert [r.docid for r in lenient.orderBy("docid").collect()] == [1, 3]
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            with pytest.raises(PySparkException, match="whole number"):
                records.article_records(raw).collect()
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")


def test_record_shapes(spark, xml):
    raw = articles.read_xml(spark, xml)
    titles = records.titles(raw, strict=False)
    assert [(f.name, f.dataType.simpleString()) for f in titles.schema] == [
        ("docid", "bigint"), ("date", "timestamp"), ("body", "string"),
    ]
    assert records.without_date(titles).columns == ["docid", "body"]
    assert {r.body for r in titles.collect()} == {"A", "B"}
    both = raw.select(fields.title_and_text().alias("b")).collect()
    assert [r.b for r in both] == ["A Hello & bye", "B ", "B zz bold tail"]


def test_broken_xml_is_reported(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<document><docid>1</title></document>")
    with pytest.raises((PySparkException, Py4JJavaError)):
        articles.read_xml(spark, str(tmp_path / "bad.xml")).collect()


def test_fields_at_any_depth(spark, tmp_path):
    (tmp_path / "deep.xml").write_text(
        "<r><document><head><docid>1</docid><info><title>A <i>b</i></title></info></head>"
        "<body><text>one</text><p><text>two<text>three</text></text></p></body></document>\n"
        "<document><docid>2</docid><x xmlns='u:v'><title>N</title></x><text/></document></r>"
    )
    rows = articles.read_xml(spark, str(tmp_path / "deep.xml")).collect()
    assert [(r.docid, r.title, r.text, r.date) for r in rows] == [
        ("1", "A b", "onetwothreethree", None), ("2", "N", "", None),
    ]


def test_one_bad_record_of_a_thousand(spark, tmp_path):
    bad = "<document><docid>500</title></document>"
    good = [f"<document><docid>{i}</docid><text>t {i}</text></document>" for i in range(1000)]
    lines = [bad if i == 500 else record for i, record in enumerate(good)]
    path = str(tmp_path / "some.xml")
    (tmp_path / "some.xml").write_text("<root>" + "\n".join(lines) + "</root>")
    counted = Observation("records")
    rows = articles.read_xml(spark, path, mode="PERMISSIVE", counted=counted).collect()
    assert counted.get == {"n_records": 1000, "n_corrupt": 1}
    assert sum(r.corrupt_record is None for r in rows) == 999
    broken = [r for r in rows if r.corrupt_record]
    assert [r.corrupt_record for r in broken] == [bad] and broken[0].docid is None
    dropped = articles.read_xml(spark, path, mode="DROPMALFORMED")
    assert dropped.columns == schemas.DECLARED_ARTICLE.names and dropped.count() == 999
    with pytest.raises((PySparkException, Py4JJavaError), match="no XML"):
        articles.read_xml(spark, path).collect()
    with pytest.raises(ValueError):
        articles.read_xml(spark, path, mode="OTHER")


def test_csv_with_a_declared_schema(spark, tmp_path):
    (tmp_path / "typed.csv").write_text("publication;year\nA;2016\nB;no\n")
    schema = T.StructType([T.StructField("publication", T.StringType()), T.StructField("year", T.LongType())])
    path = str(tmp_path / "typed.csv")
    kept = articles.read_csv(spark, path, schema=schema, mode="PERMISSIVE").collect()
    assert [(r.publication, r.year, r.corrupt_record) for r in kept] == [("A", 2016, None), ("B", None, "B;no")]
    assert articles.read_csv(spark, path, schema=schema, mode="DROPMALFORMED").collect() == [("A", 2016)]
    with pytest.raises((PySparkException, Py4JJavaError)):
        articles.read_csv(spark, path, schema=schema).collect()
    wrong = T.StructType([T.StructField("name", T.StringType()), T.StructField("year", T.LongType())])
    with pytest.raises((PySparkException, Py4JJavaError)):
        articles.read_csv(spark, path, schema=wrong, mode="DROPMALFORMED").collect()


def test_a_failed_write_leaves_the_old_output(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (3, 5):
        sinks.write_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    broken = spark.range(9).select(F.raise_error(F.lit("lost")).alias("id"))
    for write in (lambda: sinks.write_table(broken, path), lambda: sinks._lines(broken, F.col("id").cast("string"), path)):
        with pytest.raises((PySparkException, Py4JJavaError), match="lost"):
            write()
    assert spark.read.parquet(path).count() == 5
    assert os.listdir(tmp_path) == ["out"]


def test_one_xml_file_is_read_by_many_tasks(spark, tmp_path):
    body = "word " * 30
    rows = [f"<document>\n<docid>{i}</docid>\n<text>{body}{i}</text></document>\n" for i in range(2000)]
    (tmp_path / "many.xml").write_text("<root>\n" + "".join(rows) + "</root>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = articles.read_xml(spark, str(tmp_path / "many.xml"))
        assert raw.rdd.getNumPartitions() > 8
        got = {(r.docid, r.text) for r in raw.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(str(i), f"{body}{i}") for i in range(2000)}


def test_csv_months(spark, tmp_path):
    path = tmp_path / "articles.csv"
    path.write_text("publication;month;year\nA;6;2016\nB;06;2016\nC;;2015\nD;abc;2016\nA;7;2016\n")
    raw = articles.read_csv(spark, str(path))
    assert {t for _, t in raw.dtypes} == {"string"}
    table = articles.with_numbers(raw, "month", "year")
    assert sorted(r[0] for r in explore.publications_in_month(table, 6).collect()) == ["A", "B"]
    counts = explore.counts_by_publication(explore.articles_of_year(table, 2016))
    assert {tuple(r) for r in counts.collect()} == {("A", 2), ("B", 1), ("D", 1)}
    assert explore.row_count(table).first().n == 5
    assert [tuple(r) for r in explore.schema_table(table).collect()] == [
        ("publication", "string"), ("month", "bigint"), ("year", "bigint"),
    ]
    described = {r.summary: r for r in explore.describe(table).collect()}
    assert described["count"].publication == "5" and described["mean"].publication is None
    assert described["max"].year == "2016"


def test_stop_words_are_a_set(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("the\nand\nthe\n")
    assert sorted(r.word for r in words.read_stop_words(spark, str(tmp_path / "stop.txt")).collect()) == ["and", "the"]


def test_word_vectors_survive_saving(spark, tmp_path):
    lemmas = spark.createDataFrame([(["red", "blue", "green"] * 10,)] * 8, "lemmas array<string>")
    model = docvectors.train_word_vectors(lemmas, vector_size=7)
    model.save(str(tmp_path / "model"))
    loaded = words.read_word_vectors(spark, str(tmp_path / "model"))
    assert loaded.dtypes == [("word", "string"), ("vector", "array<double>")]
    wanted = {r.word: r.v for r in model.getVectors().select("word", vector_to_array("vector").alias("v")).collect()}
    assert {r.word: r.vector for r in loaded.collect()} == wanted
    assert set(wanted) == {"red", "blue", "green"} and all(len(v) == 7 for v in wanted.values())


def test_only_the_given_terms_are_trained(spark):
    rows = [(["a"] * 64 + ["b"] * 40 + ["c"] * 9 + ["d"] * 5 + ["e"],)]
    lemmas = spark.createDataFrame(rows, "lemmas array<string>")
    model = docvectors.train_word_vectors(lemmas, ["a", "c", "e", "z"], vector_size=3)
    assert {r.word for r in docvectors.vectors_of(model).collect()} == {"a", "c"}


def test_large_ids_and_unpadded_dates(spark):
    raw = spark.createDataFrame(
        [("3000000000", "2016-6-1", "t"), ("2", "", "t"), ("3", "2016-12-31 23:59:59", "t")],
        "docid string, date string, text string",
    )
    rows = {r.docid: r.date for r in records.article_records(raw).collect()}
    assert str(rows[3000000000]) == "2016-06-01 00:00:00" and rows[2] is None
    assert str(rows[3]) == "2016-12-31 00:00:00"
    bad = raw.withColumn("date", F.lit("garbage"))
    assert {r.date for r in records.article_records(bad, strict=False).collect()} == {None}
    with pytest.raises(Exception, match="not a date"):
        records.article_records(bad).collect()


def test_sample_repeats(spark):
    table = spark.range(10_000)
    one, two = (articles.sample(table, 0.01, seed=3) for _ in range(2))
    assert one.collect() == two.collect() and 50 < one.count() < 200


def test_only_a_small_input_is_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    small = spark.range(100).withColumnRenamed("id", "docid").coalesce(1)
    large = spark.range(0, 100, 1, cores * 3).withColumnRenamed("id", "docid")
    assert articles.spread(small).rdd.getNumPartitions() == cores
    assert articles.spread(large).rdd.getNumPartitions() == cores * 3


def test_has_letters(spark):
    table = spark.createDataFrame([("a1",), ("123",), ("é",), ("",), (None,), ("--ж",)], "t string")
    got = [r[0] for r in table.select(fields.has_letters("t")).collect()]
    assert got == [True, False, True, False, False, True]


def test_null_fields_read_as_empty(spark):
    table = spark.createDataFrame([(None, "x"), ("t", None)], "title string, text string")
    got = [r[0] for r in table.select(fields.title_and_text()).collect()]
    assert got == [" x", "t "]
    assert table.select(fields.date_field("title")).collect()[0][0] is None
    assert table.select(F.count(fields.string_field("text"))).first()[0] == 2
