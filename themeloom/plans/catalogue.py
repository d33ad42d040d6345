"""Named queries over the given tables.

Each takes a session and the folder of the tables. Results that another
engine is to reproduce are rounded at the very end; adding 0.0 turns a
negative zero into zero.
"""

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom import sinks
from themeloom.functions import arrays, fields, tokens
from themeloom.operators import (
    clusters,
    compare,
    cooccurrence,
    docvectors,
    explore,
    kmeans,
    lemmas,
    matrix,
    records,
    reduce,
    weights,
)
from themeloom.operators.sizes import small
from themeloom.plans import staging, themes
from themeloom.plans.staging import staged
from themeloom.sources import articles as sources
from themeloom.sources import words
from themeloom.sources.word_lists import IRREGULAR_LEMMAS

Query = Callable[[SparkSession, str], DataFrame]

# Word lists that suit the invented language of the tables.
LEMMAS = IRREGULAR_LEMMAS | {"thes": "the", "thed": "thea", "eren": "erst", "que": "quer"}
STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from")

GIVEN_CLUSTERS = range(10)

# Letters of a stem.
STEM = 4

# Terms of a wide matrix, counters of a task, and word vectors from counts.
WIDE_TERMS = 5000
HEAVY_COUNTERS = 2000
PMI_SHIFT = 1.5
COUNTED_SIZE = 16

# Digits that are compared where another engine sums in another order.
DIGITS = 9
DISTANCE_DIGITS = 6


def _rounded(value: Column | str, digits: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _articles(spark: SparkSession, folder: str) -> DataFrame:
    return sources.from_documents(_table(spark, folder, "documents"))


def _raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Articles as a reader delivers them: every field is text."""
    table = _articles(spark, folder)
    return table.select(*[F.col(c).cast("string") for c in ("docid", "date", "title", "text")])


def _lemmas(spark: SparkSession, folder: str) -> DataFrame:
    texts = _articles(spark, folder).select("docid", "date", "text")
    return lemmas.lemmatise(sources.spread(texts), LEMMAS, STOP_WORDS)


def _terms(spark: SparkSession, folder: str, stage: bool = False) -> themes.Terms:
    return themes.prepare(_articles(spark, folder), LEMMAS, STOP_WORDS, stage=stage)


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    table = _table(spark, folder, "embeddings")
    return table.select("vec_id", arrays.to_doubles(F.col("embedding")).alias("vec"), "label")


def _word_vectors(spark: SparkSession, folder: str, terms: themes.Terms) -> tuple[DataFrame, int]:
    """``word, vector`` and the length: term ``r`` takes embedding ``r``."""
    table = _embeddings(spark, folder)
    width = len(terms.vocabulary.terms)
    named = small(terms.table.select(F.col("term_id").alias("vec_id"), "term"), width)
    size = table.select(F.size("vec").alias("n")).first().n
    return table.join(named, "vec_id").select(F.col("term").alias("word"), F.col("vec").alias("vector")), size


def _vectors(
    spark: SparkSession, folder: str, terms: themes.Terms, weighting: str = "tfidf"
) -> DataFrame:
    vectors, size = _word_vectors(spark, folder, terms)
    of_terms = docvectors.vectors_of_terms(terms.vocabulary, vectors)
    return docvectors.article_vectors(terms.matrix, terms.vocabulary, of_terms, size, weighting)


def _given_labels(table: DataFrame) -> DataFrame:
    cluster = (F.col("docid") % len(GIVEN_CLUSTERS)).cast("int")
    return table.select("docid", cluster.alias("cluster"))


def _given_distances(vectors: DataFrame) -> DataFrame:
    """Distances to the means of the given labels."""
    numbered = arrays.numbered(F.col("vec"))
    centres = clusters.mean_centres(vectors, _given_labels(vectors), numbered)
    return clusters.squared_distances(vectors, centres, GIVEN_CLUSTERS)


def _fixed_projection(spark: SparkSession, folder: str) -> DataFrame:
    """The weights on a given basis: the loadings of term ``r`` are embedding ``r``."""
    terms = _terms(spark, folder)
    vectors, size = _word_vectors(spark, folder, terms)
    loadings = docvectors.vectors_of_terms(terms.vocabulary, vectors)
    basis = loadings.withColumnRenamed("vector", "loadings")
    return matrix.project(terms.weighted(), basis, len(terms.vocabulary.terms), size)


# Questions about the table of articles.


def publications_in_month(spark, folder):
    return explore.publications_in_month(_articles(spark, folder), 6)


def publication_counts_year(spark, folder):
    return explore.counts_by_publication(
        explore.articles_of_year(_articles(spark, folder), 2016)
    )


def article_count(spark, folder):
    return explore.row_count(_articles(spark, folder))


def articles_in_month_count(spark, folder):
    return explore.row_count(publications_in_month(spark, folder))


def describe_articles(spark, folder):
    numbers = explore.describe_columns(_articles(spark, folder), ["n_chars", "year", "month"])
    return numbers.select(
        "column", "count", _rounded("mean", 6).alias("mean"),
        _rounded("stddev", 6).alias("stddev"), "min", "max",
    )


def describe_text_columns(spark, folder):
    return explore.describe_columns(
        _articles(spark, folder), ["publication", "title", "text"], numeric=False
    )


def describe_all_columns(spark, folder):
    """Every column as text, as a table without types would be described."""
    table = _articles(spark, folder)
    texts = table.select(*[F.col(c).cast("string") for c in table.columns])
    return explore.describe_columns(texts, texts.columns, numeric=False)


def article_schema(spark, folder):
    return explore.schema_table(_articles(spark, folder))


def article_bodies(spark, folder):
    return records.without_date(_dated(records.article_records(_raw_records(spark, folder))))


def article_preview(spark, folder):
    return explore.preview(_articles(spark, folder))


# Fields.


def _dated(table: DataFrame) -> DataFrame:
    return table.withColumn("date", F.col("date").cast("date"))


def article_records(spark, folder):
    return _dated(records.article_records(_raw_records(spark, folder)))


def article_titles(spark, folder):
    return _dated(records.titles(_raw_records(spark, folder)))


def article_summaries(spark, folder):
    return _dated(records.summaries(_raw_records(spark, folder), field="text"))


def title_and_text(spark, folder):
    table = _articles(spark, folder)
    return table.select("docid", fields.title_and_text().alias("body"))


def has_letters(spark, folder):
    table = _articles(spark, folder)
    return table.select("docid", fields.has_letters("title").alias("title_has_letters"))


# Articles that were written out as XML or CSV, and read again.


def _escaped(name: str) -> Column:
    text = F.col(name)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def _as_xml(spark: SparkSession, folder: str) -> str:
    table = sources.spread(_raw_records(spark, folder))
    fields_of = F.concat(*[_escaped(name) for name in table.columns])
    path = staging.new_path(spark, "articles-xml")
    lines = F.concat(F.lit("<document>"), fields_of, F.lit("</document>"))
    table.select(lines.alias("value")).write.text(path)
    return path


def xml_articles(spark, folder):
    return _dated(records.article_records(sources.read_xml(spark, _as_xml(spark, folder))))


def xml_titles_any_depth(spark, folder):
    raw = sources.read_xml(spark, _as_xml(spark, folder))
    return _dated(records.titles(raw))


def _as_nested_xml(spark: SparkSession, folder: str, broken: Column) -> str:
    """Titles deep inside and with markup; records that are ``broken`` lack an end tag."""
    table = sources.spread(_raw_records(spark, folder))
    head = F.concat(
        F.lit("<head>"), _escaped("docid"), F.lit("<when>"), _escaped("date"), F.lit("</when>"),
        F.replace(_escaped("title"), F.lit("</title>"), F.lit("<b/></title>")), F.lit("</head>"),
    )
    body = F.concat(F.lit("<body><part>"), _escaped("text"), F.lit("</part></body>"))
    lines = F.concat(
        F.lit("<document>"), F.when(broken, F.lit("<open>")).otherwise(""), head, body,
        F.lit("</document>"),
    )
    path = staging.new_path(spark, "nested-xml")
    table.select(lines.alias("value")).write.text(path)
    return path


def xml_nested_fields(spark, folder):
    raw = sources.read_xml(spark, _as_nested_xml(spark, folder, F.lit(False)))
    return raw.select(
        F.col("docid").cast("long").alias("docid"), fields.date_field("date").cast("date").alias("date"),
        fields.title_and_text().alias("body"),
    )


def xml_corrupt_records(spark, folder):
    """Every seventh record is broken: kept as it stands, beside those that are whole."""
    path = _as_nested_xml(spark, folder, F.col("docid").cast("long") % 7 == 0)
    raw = sources.read_xml(spark, path, mode="PERMISSIVE")
    in_record = F.regexp_extract(sources.CORRUPT, "<docid>([0-9]+)</docid>", 1)
    bad = F.col(sources.CORRUPT).isNotNull()
    return raw.select(
        F.when(bad, in_record).otherwise(F.col("docid")).cast("long").alias("docid"),
        bad.alias("is_corrupt"), F.coalesce(F.length("text"), F.lit(0)).alias("n_text"),
    )


def csv_typed_articles(spark, folder):
    """Written as CSV and read again under a declared schema."""
    path = staging.new_path(spark, "typed-csv")
    table = _articles(spark, folder).select("docid", "publication", "date", "n_chars")
    table.write.csv(path, header=True, sep=sources.CSV_SEPARATOR)
    return sources.read_csv(spark, path, schema=table.schema)


def csv_publication_counts(spark, folder):
    path = staging.new_path(spark, "articles-csv")
    table = _articles(spark, folder).select("docid", "publication", "title", "year", "month")
    table.write.csv(path, header=True, sep=sources.CSV_SEPARATOR)
    again = sources.with_numbers(sources.read_csv(spark, path), "year", "month")
    return explore.counts_by_publication(explore.articles_of_year(again, 2016))


# Lemmas and weights.


def plain_text(spark, folder):
    table = sources.spread(_articles(spark, folder).select("docid", "text"))
    return table.select("docid", tokens.plain_text(F.col("text")).alias("plain"))


def kept_lemmas(spark, folder):
    return _lemma_lines(_lemmas(spark, folder))


def _lemma_lines(table: DataFrame) -> DataFrame:
    return table.select(
        "docid", F.size("lemmas").alias("n_lemmas"), F.array_join("lemmas", " ").alias("lemmas")
    )


def _stems(texts: DataFrame) -> DataFrame:
    """A lemma table of the articles' own words: the first letters of each longer word."""
    words = texts.select(F.explode(F.array_distinct(tokens.kept_words(F.col("text")))).alias("form"))
    stem = F.substring("form", 1, STEM).alias("lemma")
    return words.distinct().where(F.length("form") > STEM).select("form", stem)


def kept_lemmas_stemmed(spark, folder):
    """With a lemma table of many thousand forms, and stop words out of a file."""
    texts = sources.spread(_articles(spark, folder).select("docid", "text"))
    path = staging.new_path(spark, "stop-words")
    spark.createDataFrame([(word,) for word in STOP_WORDS * 2], "value string").write.text(path)
    stop_words = words.read_stop_words(spark, path)
    return _lemma_lines(lemmas.lemmatise(texts, _stems(texts), stop_words))


def kept_lemmas_joined(spark, folder):
    """The same by joins, as for long word lists."""
    texts = sources.spread(_articles(spark, folder).select("docid", "text"))
    return _lemma_lines(lemmas.lemmatise_by_join(texts, LEMMAS, STOP_WORDS))


def kept_lemmas_python(spark, folder):
    """The same with a lemmatiser in Python."""

    def make_lemmatiser():
        lemma_of = dict(LEMMAS)
        return lambda text: [lemma_of.get(word, word) for word in text.split(" ")]

    texts = sources.spread(_articles(spark, folder).select("docid", "text"))
    return _lemma_lines(lemmas.lemmatise_with(texts, make_lemmatiser, STOP_WORDS))


def distinct_lemmas(spark, folder):
    return lemmas.distinct_lemmas(_lemmas(spark, folder))


def term_frequency(spark, folder):
    return weights.term_frequency(_lemmas(spark, folder))


def kept_in_article(spark, folder):
    return weights.kept_in_article(_lemmas(spark, folder))


def doc_frequency(spark, folder):
    return weights.document_frequency(_lemmas(spark, folder))


def doc_frequency_top(spark, folder):
    vocabulary = weights.build_vocabulary(_lemmas(spark, folder))
    return vocabulary.table(spark).select("term", "df")


def doc_frequency_heavy(spark, folder):
    """The same by bounded counters and an exact count of the terms that remain."""
    vocabulary = weights.build_vocabulary(_lemmas(spark, folder), counters=HEAVY_COUNTERS)
    return vocabulary.table(spark).select("term", "df")


def _pair_counts(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    return staged(cooccurrence.cooccurrences(_lemmas(spark, folder), names), "word-pairs")


def _named_pairs(terms: themes.Terms, pairs: DataFrame) -> DataFrame:
    """Both words of a pair by their name."""
    named = small(terms.table.select("term_id", "term"), len(terms.vocabulary.terms))
    for key, name in (("word_id", "word"), ("context_id", "context")):
        pairs = pairs.join(named.toDF(key, name), key).drop(key)
    return pairs


def cooccurrence_counts(spark, folder):
    terms = _terms(spark, folder)
    counts = _pair_counts(spark, folder, terms.vocabulary.terms)
    return _named_pairs(terms, counts).select("word", "context", "n")


def positive_pmi(spark, folder):
    terms = _terms(spark, folder)
    names = terms.vocabulary.terms
    pairs = cooccurrence.positive_pmi(_pair_counts(spark, folder, names), len(names), PMI_SHIFT)
    return _named_pairs(terms, pairs).select("word", "context", _rounded("pmi", 6).alias("pmi"))


def term_index(spark, folder):
    vocabulary = weights.build_vocabulary(_lemmas(spark, folder))
    return vocabulary.table(spark).withColumn("idf", _rounded("idf", 9))


def term_weights(spark, folder):
    terms = _terms(spark, folder)
    rows = weights.weight_rows(terms.matrix, terms.vocabulary)
    return rows.select("docid", "term_id", _rounded("weight", 9).alias("weight"))


def term_weights_binary(spark, folder):
    terms = _terms(spark, folder)
    return weights.weight_rows(terms.matrix, terms.vocabulary, "binary")


# Vectors.


def _long_vectors(vectors: DataFrame, digits: int = 6) -> DataFrame:
    return matrix.long_form(vectors, "vec").select(
        "docid", "pos", _rounded("value", digits).alias("value")
    )


def doc_vectors(spark, folder):
    return _long_vectors(_vectors(spark, folder, _terms(spark, folder)))


def doc_vectors_binary(spark, folder):
    return _long_vectors(_vectors(spark, folder, _terms(spark, folder), "binary"))


def doc_vectors_nonzero(spark, folder):
    return _long_vectors(matrix.nonzero_rows(_vectors(spark, folder, _terms(spark, folder))))


def concat_vectors(spark, folder):
    stacked = arrays.stack(F.col("vec"), arrays.scale(F.lit(2.0), F.col("vec")))
    rows = _embeddings(spark, folder).select("vec_id", F.posexplode(stacked).alias("pos", "value"))
    return rows.select("vec_id", "pos", _rounded("value", 6).alias("value"))


def add_vectors(spark, folder):
    total = arrays.add(F.col("vec"), arrays.scale(F.lit(0.5), F.col("vec")))
    rows = _embeddings(spark, folder).select("vec_id", F.posexplode(total).alias("pos", "value"))
    return rows.select("vec_id", "pos", _rounded("value", 6).alias("value"))


def vector_norms(spark, folder):
    vec = F.col("vec")
    origin = arrays.zeros(F.size(vec))
    return _embeddings(spark, folder).select(
        "vec_id",
        _rounded(arrays.l1_norm(vec), 6).alias("l1"),
        _rounded(arrays.squared_distance(vec, origin), 6).alias("from_origin"),
    )


def standardised(spark, folder):
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    rows = reduce.standardise(vecs).select("docid", vector_to_array("features").alias("vec"))
    return _long_vectors(rows, 5)


def covariance(spark, folder):
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    table = reduce.covariance(vecs)
    return table.select("i", "j", _rounded("cov", 9).alias("cov"))


def project_on_basis(spark, folder):
    rows = matrix.long_form(_fixed_projection(spark, folder), "projection", "component")
    return rows.select("docid", "component", _rounded("value", 6).alias("value"))


def projection_summary(spark, folder):
    table = matrix.summarise(_fixed_projection(spark, folder), "projection")
    figures = [c for c in table.columns if c not in ("component", "count", "nonzeros")]
    return table.withColumns({c: _rounded(c, 6) for c in figures})


# Centres and labels that are given.


def assign_given_centres(spark, folder):
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    labels = clusters.assign(_given_distances(vecs), DIGITS)
    return labels.select("docid", "cluster", _rounded("distance", 6).alias("distance"))


def labelled_by_date(spark, folder):
    table = _articles(spark, folder)
    return clusters.labelled_by_date(table, _given_labels(table))


def top_terms_per_centre(spark, folder):
    terms = _terms(spark, folder)
    weighted = arrays.entries(F.col("features"))
    labels = _given_labels(_articles(spark, folder))
    centres = clusters.mean_centres(terms.weighted(), labels, weighted)
    top = clusters.top_terms(centres, terms.table, digits=DIGITS)
    return top.withColumn("value", _rounded("value", 9))


def nearest_docs_per_centre(spark, folder):
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    near = clusters.nearest_articles(_given_distances(vecs), digits=DISTANCE_DIGITS)
    return near.withColumn("distance", _rounded("distance", 6))


def terms_of_nearest(spark, folder):
    terms = _terms(spark, folder, stage=True)
    vecs = staged(_vectors(spark, folder, terms), "article-vectors")
    near = clusters.nearest_articles(_given_distances(vecs), digits=DISTANCE_DIGITS)
    most = len(GIVEN_CLUSTERS) * clusters.NEAREST_ARTICLES
    best = clusters.terms_of_articles(
        terms.weighted(), near, terms.table, most, digits=DIGITS
    )
    return best.withColumn("weight", _rounded("weight", 9))


def nearest_vectors_per_label(spark, folder):
    table = _embeddings(spark, folder).withColumnRenamed("vec_id", "docid")
    labels = table.select("docid", F.col("label").alias("cluster"))
    centres = clusters.mean_centres(table, labels, arrays.numbered(F.col("vec")))
    distances = clusters.squared_distances(table, centres, GIVEN_CLUSTERS)
    near = clusters.nearest_articles(distances, digits=DISTANCE_DIGITS)
    return near.withColumn("distance", _rounded("distance", 6))


def _two_labelings(spark, folder) -> DataFrame:
    table = _table(spark, folder, "documents").withColumnRenamed("doc_id", "docid")
    by_language = table.select("docid", F.col("lang").alias("cluster"))
    by_source = table.select("docid", F.col("source").alias("cluster"))
    return compare.contingency(by_language, by_source)


def compare_labelings(spark, folder):
    return _two_labelings(spark, folder)


def compare_agreement(spark, folder):
    table = compare.agreement(_two_labelings(spark, folder))
    return table.select(
        "n", *[_rounded(c, 9).alias(c) for c in ("purity_a", "purity_b", "adjusted_rand")]
    )


# Text outputs, read back as lines.


def term_index_lines(spark, folder):
    path = staging.new_path(spark, "term-index-lines")
    sinks.write_term_index(_terms(spark, folder).table, path)
    return spark.read.text(path)


def labelled_lines(spark, folder):
    path = staging.new_path(spark, "labelled-lines")
    sinks.write_labelled(labelled_by_date(spark, folder), path)
    return spark.read.text(path)


def _saved_word_vectors(spark: SparkSession, folder: str) -> str:
    """The embeddings as a word-vector model keeps them: float vectors below ``data``."""
    path = staging.new_path(spark, "word-vectors")
    table = _table(spark, folder, "embeddings")
    word = F.concat(F.lit("w"), F.col("vec_id")).alias("word")
    table.select(word, F.col("embedding").alias("vector")).write.parquet(path + "/data")
    return path


def saved_word_vectors(spark, folder):
    vectors = words.read_word_vectors(spark, _saved_word_vectors(spark, folder))
    rows = vectors.select("word", F.posexplode("vector").alias("pos", "value"))
    return rows.select("word", "pos", _rounded("value", 6).alias("value"))


def vector_lines(spark, folder):
    """Article vectors as lines, read back as numbers."""
    path = staging.new_path(spark, "vector-lines")
    vecs = _vectors(spark, folder, _terms(spark, folder))
    for _ in range(2):  # the second replaces the first
        sinks.write_vectors(vecs, "vec", path)
    numbers = F.split("value", sinks.SEPARATOR).cast("array<double>")
    return spark.read.text(path).select(
        F.size(numbers).alias("n"),
        _rounded(F.aggregate(numbers, F.lit(0.0), lambda total, x: total + x), 6).alias("total"),
    )


def label_lines(spark, folder):
    path = staging.new_path(spark, "label-lines")
    sinks.write_labels(_given_labels(_articles(spark, folder)), path)
    return spark.read.text(path)


# Certificates of fitted steps: what must hold of a right result, in figures that SQL can state.


def _holds(condition: Column, name: str) -> Column:
    return F.coalesce(condition, F.lit(False)).alias(name)


def _beside(*tables: DataFrame) -> DataFrame:
    """Tables of one row, such as totals, side by side."""
    fields_of = [field for table in tables for field in table.schema.fields]
    row = tuple(value for table in tables for value in table.first())
    return tables[0].sparkSession.createDataFrame([row], T.StructType(fields_of))


def _svd_certificate(spark: SparkSession, terms: themes.Terms, solver: str) -> DataFrame:
    """What the projection keeps and what it leaves add up to all squares; ``A'A v = s2 v``."""
    weighted = terms.weighted()
    svd, projection = themes.lsa_projection(terms, solver=solver)
    k = len(svd.values)
    squares = F.aggregate(
        arrays.entries(F.col("features")), F.lit(0.0),
        lambda total, e: total + e.getField("value") * e.getField("value"),
    )
    entry = F.explode_outer(arrays.entries(F.col("features"))).alias("entry")
    rows = weighted.select("docid", "features").join(projection, "docid")
    rows = staged(rows.select("docid", squares.alias("squares"), "projection", "features"), "svd-rows")
    laid_out = rows.select("projection", entry).where(F.col("entry").isNotNull())
    turned = laid_out.groupBy("entry.term_id").agg(
        *[F.sum(F.col("entry.value") * F.get("projection", i)).alias(f"c{i}") for i in range(k)]
    )
    basis = matrix.basis_table(spark, svd.basis)
    residuals = turned.join(basis, "term_id").agg(
        *[
            F.max(F.abs(F.col(f"c{i}") - float(svd.values[i] ** 2) * F.get("loadings", i))).alias(f"r{i}")
            for i in range(k)
        ]
    ).select(F.greatest(*[F.col(f"r{i}") for i in range(k)], F.lit(0.0)).alias("residual"))
    kept = F.aggregate("projection", F.lit(0.0), lambda total, x: total + x * x)
    energy = float((svd.values**2).sum())
    figures = rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("squares").alias("squares"), F.sum(kept).alias("kept"),
        F.min(F.col("squares") - kept).alias("least_left"),
    )
    orthonormal = float(abs(svd.basis.T @ svd.basis - np.eye(k)).max())
    return _beside(figures, residuals).select(
        "n", _rounded("squares", 6).alias("squares"),
        _holds(F.abs(F.col("kept") - energy) < 1e-9 * energy, "kept_is_squared_values"),
        _holds(F.col("least_left") > -1e-9, "no_row_grows"),
        _holds(F.col("residual") < 1e-9 * energy, "vectors_are_eigenvectors"),
        F.lit(orthonormal < 1e-9).alias("vectors_are_orthonormal"),
    )


def svd_certificate(spark, folder):
    return _svd_certificate(spark, _terms(spark, folder, stage=True), "gram")


def wide_svd_certificate(spark, folder):
    """The same for five times as many terms and the randomised solver."""
    terms = themes.prepare(_articles(spark, folder), LEMMAS, STOP_WORDS, WIDE_TERMS)
    return _svd_certificate(spark, terms, "randomised")


def counted_vectors_certificate(spark, folder):
    """Columns of the word vectors are orthogonal, and ``A A' w = s2 w`` for each."""
    terms = _terms(spark, folder)
    names = terms.vocabulary.terms
    pairs = staged(cooccurrence.positive_pmi(_pair_counts(spark, folder, names), len(names)), "pairs")
    rows = staged(cooccurrence.rows_of(pairs), "word-rows")
    made = cooccurrence.factorised(rows, len(names), COUNTED_SIZE, passes=20, tolerance=1e-12)
    made = staged(made, "word-vectors")
    ks = range(COUNTED_SIZE)
    sums = {(i, j): F.sum(F.get("vector", i) * F.get("vector", j)) for i in ks for j in ks if i <= j}
    moments = made.agg(*[total.alias(f"v{i}_{j}") for (i, j), total in sums.items()]).first()
    values = [moments[f"v{i}_{i}"] for i in ks]
    largest = max(values)
    crossed = max(abs(moments[f"v{i}_{j}"]) for i, j in sums if i != j)

    def turned(vectors: DataFrame, key: str, other: str) -> DataFrame:
        met = pairs.join(small(vectors.withColumnRenamed("word_id", key), len(names), COUNTED_SIZE), key)
        parts = [F.sum(F.col("pmi") * F.get("vector", i)) for i in ks]
        return met.groupBy(F.col(other).alias("word_id")).agg(F.array(*parts).alias("vector"))

    back = turned(turned(made, "word_id", "context_id"), "context_id", "word_id")
    both = back.withColumnRenamed("vector", "image").join(made, "word_id")
    off = [F.abs(F.get("image", i) - values[i] ** 2 * F.get("vector", i)) for i in ks]
    residual = both.agg(F.max(F.greatest(*off)).alias("residual"))
    squares = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("word_id").alias("n_words"),
        F.sum(F.col("pmi") * F.col("pmi")).alias("squares"),
    )
    return _beside(squares, residual).select(
        "n_pairs", "n_words", _rounded("squares", 5).alias("squares"),
        F.lit(crossed < 1e-9 * largest).alias("columns_are_orthogonal"),
        F.lit(values == sorted(values, reverse=True)).alias("largest_first"),
        _holds(F.col("residual") < 1e-6 * largest**2, "vectors_are_eigenvectors"),
    )


def pca_certificate(spark, folder):
    """Components of standardised vectors are uncorrelated and explain their shares."""
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    components, projection = themes.pca_projection(vecs)
    k = len(components.explained)
    projection = staged(projection, "pca-rows")
    size = vecs.select(F.size("vec").alias("n")).first().n
    total = reduce.standardise(vecs).select(vector_to_array("features").alias("z")).select(
        F.explode("z").alias("x")
    ).agg(F.sum(F.col("x") * F.col("x")).alias("all_squares"), (F.count("x") / size).alias("n"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    moments = projection.agg(
        *[F.covar_samp(F.get("projection", i), F.get("projection", j)).alias(f"v{i}_{j}") for i, j in pairs]
    )
    crossed = F.greatest(*[F.abs(F.col(f"v{i}_{j}")) for i, j in pairs if i != j])
    gaps = [
        F.abs(F.col(f"v{i}_{i}") / (F.col("all_squares") / (F.col("n") - 1)) - float(share))
        for i, share in enumerate(components.explained)
    ]
    falls = [F.col(f"v{i}_{i}") >= F.col(f"v{i + 1}_{i + 1}") - 1e-9 for i in range(k - 1)]
    in_order = falls[0]
    for fall in falls[1:]:
        in_order = in_order & fall
    return _beside(total, moments).select(
        F.col("n").cast("long").alias("n"), _rounded(F.col("all_squares") / (F.col("n") - 1), 5).alias("variance"),
        _holds(crossed < 1e-8, "uncorrelated"), _holds(F.greatest(*gaps) < 1e-9, "explain_their_shares"),
        _holds(in_order, "largest_first"),
    )


def _kmeans_certificate(spark: SparkSession, folder: str, way: str) -> DataFrame:
    """Labels are nearest centres, centres are means, and squares add up.

    The squared distances to the own centre, and those of the centres to the
    mean of all, weighted by their sizes, are together those of all rows to
    the mean.
    """
    terms = _terms(spark, folder, stage=True)
    if way == "terms":
        features = terms.weighted().select("docid", "features")
        width = len(terms.vocabulary.terms)
    else:
        vecs = staged(_vectors(spark, folder, terms), "article-vectors")
        features = vecs.select("docid", matrix.as_features("vec").alias("features"))
        width = vecs.select(F.size("vec").alias("n")).first().n
    fitted = clusters.fit_themes(features)
    labels = staged(fitted.assign(features), "labels")
    entries = staged(
        features.select("docid", F.explode_outer(arrays.entries(F.col("features"))).alias("entry"))
        .where(F.col("entry").isNotNull()).select("docid", F.col("entry.term_id").alias("pos"), "entry.value"),
        "entries",
    )
    centres = fitted.centres(spark)
    lengths = centres.groupBy("cluster").agg(F.sum(F.col("value") * F.col("value")).alias("length"))
    squares = entries.groupBy("docid").agg(F.sum(F.col("value") * F.col("value")).alias("squares"))
    dots = entries.join(small(centres.withColumnRenamed("value", "c"), width * clusters.CLUSTERS, 3), "pos")
    dots = dots.groupBy("docid", "cluster").agg(F.sum(F.col("value") * F.col("c")).alias("dot"))
    given = F.explode(F.array(*[F.lit(c) for c in range(len(fitted.matrix))])).alias("cluster")
    every = labels.select("docid", F.col("cluster").alias("own"), given)
    every = every.join(small(lengths, clusters.CLUSTERS), "cluster")
    far = every.join(dots, ["docid", "cluster"], "left").join(squares, "docid", "left").select(
        "docid", "own", "cluster",
        (F.coalesce("squares", F.lit(0.0)) - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("length")).alias("d"),
    )
    rows = far.groupBy("docid", "own").agg(
        F.min("d").alias("least"), F.max(F.when(F.col("cluster") == F.col("own"), F.col("d"))).alias("d")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("within"),
        F.count(F.when(F.col("d") <= F.col("least") + 1e-9, 1)).alias("n_at_nearest"),
    )
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    means = entries.join(labels.select("docid", "cluster"), "docid").groupBy("cluster", "pos").agg(
        F.sum("value").alias("total")
    )
    held = centres.join(sizes, "cluster").join(means, ["cluster", "pos"], "left").select(
        "pos", "size", "value", (F.coalesce("total", F.lit(0.0)) / F.col("size")).alias("mean")
    )
    overall = held.groupBy("pos").agg(
        (F.sum(F.col("size") * F.col("mean")) / F.sum("size")).alias("centre"),
        F.sum(F.col("size") * F.col("mean") * F.col("mean")).alias("squares"),
        F.sum("size").alias("size"), F.max(F.abs(F.col("value") - F.col("mean"))).alias("gap"),
    ).agg(
        F.sum(F.col("squares") - F.col("size") * F.col("centre") * F.col("centre")).alias("between"),
        F.max("gap").alias("gap"),
    )
    return _beside(rows, overall).select(
        "n", "n_at_nearest",
        # A fit ends when centres move less than the tolerance.
        _holds(F.col("gap") < kmeans.TOLERANCE, "centres_are_means"),
        _rounded(F.col("within") + F.col("between"), 4).alias("all_squares"),
        _holds(F.abs(F.col("within") - fitted.cost) < 1e-6 * F.col("within"), "cost_is_within"),
    )


def kmeans_terms_certificate(spark, folder):
    return _kmeans_certificate(spark, folder, "terms")


def kmeans_vectors_certificate(spark, folder):
    return _kmeans_certificate(spark, folder, "vectors")


def saved_themes(spark, folder):
    """Themes that were saved and loaded again label every article as before."""
    weighted = _terms(spark, folder, stage=True).weighted()
    fitted = clusters.fit_themes(weighted)
    path = staging.new_path(spark, "themes")
    fitted.save(spark, path)
    again = clusters.load_themes(spark, path)
    both = fitted.assign(weighted).join(
        again.assign(weighted).select("docid", F.col("cluster").alias("again")), "docid"
    )
    return both.select("docid", (F.col("cluster") == F.col("again")).alias("same"))


# Fitted steps.


def lsa_singular_values(spark, folder):
    terms = _terms(spark, folder)
    svd = matrix.truncated_svd(terms.weighted(), len(terms.vocabulary.terms))
    return svd.values_table(spark)


def lsa_projection(spark, folder):
    return themes.lsa_projection(_terms(spark, folder, stage=True))[1]


def pca_projection(spark, folder):
    vecs = staged(_vectors(spark, folder, _terms(spark, folder)), "article-vectors")
    return themes.pca_projection(vecs)[1]


def kmeans_terms(spark, folder):
    weighted = _terms(spark, folder, stage=True).weighted()
    return clusters.by_date(clusters.fit_themes(weighted).assign(weighted))


def lsa_top_terms(spark, folder):
    terms = _terms(spark, folder, stage=True)
    centres = clusters.fit_themes(terms.weighted()).centres(spark)
    return clusters.top_terms(centres, terms.table, digits=DIGITS)


def _vector_themes(spark, folder, stage=True):
    terms = _terms(spark, folder, stage)
    vecs = staged(_vectors(spark, folder, terms), "article-vectors")
    features = vecs.select("docid", matrix.as_features("vec").alias("features"))
    return terms, vecs, features, clusters.fit_themes(features)


def kmeans_doc_vectors(spark, folder):
    _, _, features, fitted = _vector_themes(spark, folder, stage=False)
    return clusters.labelled_by_date(_articles(spark, folder), fitted.assign(features))


def theme_nearest_terms(spark, folder):
    terms, vecs, _, fitted = _vector_themes(spark, folder)
    near = themes.nearest_of(fitted, vecs)
    most = len(fitted.matrix) * clusters.NEAREST_ARTICLES
    best = clusters.terms_of_articles(
        terms.weighted(), near, terms.table, most, digits=DIGITS
    )
    named = near.select("cluster", F.col("rank").alias("nearness"), "docid")
    return named.join(best, "docid").select("cluster", "nearness", "docid", "rank", "term", "weight")


def compare_ways(spark, folder):
    terms, _, features, fitted = _vector_themes(spark, folder)
    weighted = terms.weighted()
    by_terms = clusters.fit_themes(weighted).assign(weighted)
    return compare.contingency(by_terms, fitted.assign(features))


def kmeans_lsa_projection(spark, folder):
    projection = staged(lsa_projection(spark, folder), "lsa-projection")
    features = projection.select("docid", matrix.as_features("projection").alias("features"))
    return clusters.fit_themes(features).assign(features)


def kmeans_pca_projection(spark, folder):
    projection = staged(pca_projection(spark, folder), "pca-projection")
    features = projection.select("docid", matrix.as_features("projection").alias("features"))
    return clusters.fit_themes(features).assign(features)


def compare_ways_agreement(spark, folder):
    return compare.agreement(compare_ways(spark, folder))


def theme_silhouettes(spark, folder):
    """How well separated the themes of each way are."""
    terms, _, features, fitted = _vector_themes(spark, folder)
    weighted = terms.weighted()
    ways = {
        "term weights": (clusters.fit_themes(weighted), weighted),
        "article vectors": (fitted, features),
    }
    rows = [
        (name, compare.silhouette(themes_of.assign(table, keep_features=True)))
        for name, (themes_of, table) in ways.items()
    ]
    return spark.createDataFrame(rows, "way string, silhouette double")


def doc_vectors_trained(spark, folder):
    """Article vectors from word vectors of the articles' own lemmas."""
    cut = _lemmas(spark, folder)
    cut = staged(cut, "lemmas")
    terms = themes.prepare_lemmas(cut, stage=False)
    words = terms.vocabulary.terms
    trained = docvectors.vectors_of(docvectors.train_word_vectors(cut, words))
    return themes.vectors_of_articles(terms, trained, docvectors.VECTOR_SIZE)


def doc_vectors_counted(spark, folder):
    """Article vectors from word vectors that were counted and factorised."""
    cut = staged(_lemmas(spark, folder), "lemmas")
    terms = themes.prepare_lemmas(cut, stage=False)
    counted = docvectors.counted_word_vectors(cut, terms.vocabulary.terms)
    return themes.vectors_of_articles(terms, counted, docvectors.VECTOR_SIZE)


def train_word_vectors(spark, folder):
    model = docvectors.train_word_vectors(_lemmas(spark, folder))
    return docvectors.vectors_of(model)


QUERIES: tuple[Query, ...] = (
    publications_in_month,
    publication_counts_year,
    article_count,
    articles_in_month_count,
    describe_articles,
    describe_text_columns,
    article_preview,
    describe_all_columns,
    article_schema,
    article_bodies,
    article_records,
    article_titles,
    article_summaries,
    title_and_text,
    has_letters,
    xml_articles,
    xml_titles_any_depth,
    xml_nested_fields,
    xml_corrupt_records,
    csv_typed_articles,
    csv_publication_counts,
    plain_text,
    kept_lemmas,
    kept_lemmas_stemmed,
    kept_lemmas_joined,
    kept_lemmas_python,
    distinct_lemmas,
    term_frequency,
    kept_in_article,
    doc_frequency,
    doc_frequency_top,
    doc_frequency_heavy,
    cooccurrence_counts,
    positive_pmi,
    term_index,
    term_weights,
    term_weights_binary,
    doc_vectors,
    doc_vectors_binary,
    doc_vectors_nonzero,
    concat_vectors,
    add_vectors,
    vector_norms,
    standardised,
    covariance,
    project_on_basis,
    projection_summary,
    assign_given_centres,
    labelled_by_date,
    top_terms_per_centre,
    nearest_docs_per_centre,
    terms_of_nearest,
    nearest_vectors_per_label,
    compare_labelings,
    compare_agreement,
    term_index_lines,
    labelled_lines,
    saved_word_vectors,
    vector_lines,
    label_lines,
    svd_certificate,
    wide_svd_certificate,
    counted_vectors_certificate,
    pca_certificate,
    kmeans_terms_certificate,
    kmeans_vectors_certificate,
    saved_themes,
    lsa_singular_values,
    lsa_projection,
    pca_projection,
    kmeans_terms,
    lsa_top_terms,
    kmeans_doc_vectors,
    theme_nearest_terms,
    kmeans_lsa_projection,
    kmeans_pca_projection,
    compare_ways,
    compare_ways_agreement,
    theme_silhouettes,
    doc_vectors_trained,
    doc_vectors_counted,
    train_word_vectors,
)
