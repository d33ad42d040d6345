"""The same queries in SQL, for DuckDB, over the same tables."""

from themeloom.plans.catalogue import LEMMAS, PMI_SHIFT, STEM, STOP_WORDS, WIDE_TERMS

_ARTICLES = r"""
articles AS (
  SELECT doc_id AS docid, source AS publication, split_part(text, chr(10), 1) AS title, text, n_chars,
         d AS date, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month
  FROM (SELECT *, DATE '2015-07-01' + CAST((doc_id * 37) % 731 AS INTEGER) AS d FROM documents)
)"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)


_KEPT = rf"""
lemma_list(form, lemma) AS (VALUES {_values(LEMMAS.items())}),
stop_list(word) AS (VALUES {_values((w,) for w in STOP_WORDS)}),
cut AS (SELECT doc_id AS docid, regexp_split_to_array(lower(text), '\W+') AS words FROM documents),
forms AS (SELECT docid, unnest(words) AS form, generate_subscripts(words, 1) AS pos FROM cut),
resolved AS (
  SELECT f.docid, f.pos, coalesce(l.lemma, f.form) AS lemma
  FROM forms f LEFT JOIN lemma_list l ON l.form = f.form
),
kept AS (
  SELECT docid, pos, lemma FROM resolved
  WHERE length(lemma) >= 3 AND regexp_matches(lemma, '^[a-z]+$')
    AND lemma NOT IN (SELECT word FROM stop_list)
)"""

_WEIGHTS = (
    _KEPT
    + """,
counted AS (SELECT docid, lemma AS term, count(*) AS tf FROM kept GROUP BY docid, lemma),
lengths AS (SELECT docid, count(*) AS n FROM kept GROUP BY docid),
frequencies AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
vocab AS (
  SELECT CAST(row_number() OVER (ORDER BY df DESC, term) - 1 AS INTEGER) AS term_id, term, df,
         ln(CAST((SELECT count(*) FROM documents) AS DOUBLE) / df) AS idf
  FROM frequencies ORDER BY df DESC, term LIMIT 1000
),
weights AS (
  SELECT c.docid, v.term_id, CAST(c.tf AS DOUBLE) / l.n * v.idf AS weight
  FROM counted c JOIN vocab v ON v.term = c.term JOIN lengths l ON l.docid = c.docid
)"""
)


def _vectors(weight: str = "weight") -> str:
    return (
        _WEIGHTS
        + f""",
term_vectors AS (
  SELECT v.term_id, CAST(generate_subscripts(e.embedding, 1) - 1 AS INTEGER) AS pos,
         CAST(unnest(e.embedding) AS DOUBLE) AS x
  FROM vocab v JOIN embeddings e ON e.vec_id = v.term_id
),
sums AS (
  SELECT w.docid, t.pos, sum({weight} * t.x) AS s, sum({weight}) AS total
  FROM weights w JOIN term_vectors t ON t.term_id = w.term_id GROUP BY w.docid, t.pos
),
positions AS (SELECT CAST(unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS INTEGER) AS pos),
vecs AS (
  SELECT d.doc_id AS docid, p.pos, CASE WHEN s.total > 0 THEN s.s / s.total ELSE 0.0 END AS value
  FROM documents d CROSS JOIN positions p LEFT JOIN sums s ON s.docid = d.doc_id AND s.pos = p.pos
)"""
    )


_DISTANCES = (
    _vectors()
    + """,
centres AS (
  SELECT CAST(docid % 10 AS INTEGER) AS cluster, pos, avg(value) AS value FROM vecs GROUP BY 1, 2
),
distances AS (
  SELECT v.docid, c.cluster, sum((v.value - c.value) * (v.value - c.value)) AS distance
  FROM vecs v JOIN centres c ON c.pos = v.pos GROUP BY v.docid, c.cluster
),
nearest AS (
  SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 6), docid) AS INTEGER) AS rank,
         docid, distance
  FROM distances
)"""
)

_PAIRS = (
    _WEIGHTS
    + """,
placed AS (SELECT docid, lemma, row_number() OVER (PARTITION BY docid ORDER BY pos) AS place FROM kept),
near AS (
  SELECT a.docid, a.lemma AS a, b.lemma AS b
  FROM (SELECT docid, place, lemma, unnest([1, 2, 3, 4, 5]) AS far FROM placed) a
  JOIN placed b ON b.docid = a.docid AND b.place = a.place + a.far
),
counts AS (
  SELECT word, context, count(*) AS n
  FROM (SELECT a AS word, b AS context FROM near UNION ALL SELECT b, a FROM near)
  WHERE word IN (SELECT term FROM vocab) AND context IN (SELECT term FROM vocab)
  GROUP BY word, context
),
sides AS (SELECT word, CAST(sum(n) AS DOUBLE) AS own FROM counts GROUP BY word),
informed AS (
  SELECT c.word, c.context, ln(c.n * (SELECT sum(own) FROM sides) / (s.own * o.own)) AS pmi
  FROM counts c JOIN sides s ON s.word = c.word JOIN sides o ON o.word = c.context
)"""
)

_PROJECTION = (
    _WEIGHTS
    + """,
basis AS (
  SELECT v.term_id, CAST(generate_subscripts(e.part, 1) - 1 AS INTEGER) AS component,
         CAST(unnest(e.part) AS DOUBLE) AS x
  FROM vocab v JOIN (SELECT vec_id, embedding AS part FROM embeddings) e ON e.vec_id = v.term_id
),
dots AS (
  SELECT w.docid, b.component, sum(w.weight * b.x) AS s
  FROM weights w JOIN basis b ON b.term_id = w.term_id GROUP BY w.docid, b.component
),
projected AS (
  SELECT d.doc_id AS docid, c.component, coalesce(s.s, 0.0) AS value
  FROM documents d CROSS JOIN (
    SELECT CAST(unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS INTEGER) AS component
  ) c
  LEFT JOIN dots s ON s.docid = d.doc_id AND s.component = c.component
)"""
)

_EMBEDDED = """
long AS (
  SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
         CAST(unnest(embedding) AS DOUBLE) AS x, len(embedding) AS n
  FROM embeddings
)"""


def _number_row(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, round(avg({column}), 6) AS mean, "
        f"round(stddev_samp({column}), 6) AS stddev, CAST(min({column}) AS DOUBLE) AS min, "
        f"CAST(max({column}) AS DOUBLE) AS max FROM articles"
    )


def _text_row(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count({column}) AS count, min({column}) AS min, "
        f"max({column}) AS max FROM articles"
    )


def _round(value: str, digits: int, name: str) -> str:
    """Rounded, with a negative zero turned into zero."""
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0 ELSE round({value}, {digits}) END AS {name}"


_LONG = f"SELECT docid, pos, {_round('value', 6, 'value')} FROM vecs"

_CONTINGENCY = """
table_ab AS (
  SELECT a.cluster_a, b.cluster_b, count(*) AS n
  FROM (SELECT doc_id, lang AS cluster_a FROM documents) a
  JOIN (SELECT doc_id, source AS cluster_b FROM documents) b ON a.doc_id = b.doc_id
  GROUP BY a.cluster_a, b.cluster_b
)"""

_LEMMA_LINES = f"""WITH {_KEPT}
    SELECT d.doc_id AS docid, CAST(count(k.lemma) AS INTEGER) AS n_lemmas,
           coalesce(string_agg(k.lemma, ' ' ORDER BY k.pos), '') AS lemmas
    FROM documents d LEFT JOIN kept k ON k.docid = d.doc_id GROUP BY d.doc_id"""

_STEMMED = rf"""WITH
stop_list(word) AS (VALUES {_values((w,) for w in STOP_WORDS)}),
cut AS (SELECT doc_id AS docid, regexp_split_to_array(lower(text), '\W+') AS words FROM documents),
forms AS (SELECT docid, unnest(words) AS form, generate_subscripts(words, 1) AS pos FROM cut),
kept AS (
  SELECT docid, pos, CASE WHEN length(form) > {STEM} THEN substr(form, 1, {STEM}) ELSE form END AS lemma
  FROM forms WHERE length(form) >= 3 AND regexp_matches(form, '^[a-z]+$')
)
SELECT d.doc_id AS docid, CAST(count(k.lemma) AS INTEGER) AS n_lemmas,
       coalesce(string_agg(k.lemma, ' ' ORDER BY k.pos), '') AS lemmas
FROM documents d LEFT JOIN (SELECT * FROM kept WHERE lemma NOT IN (SELECT word FROM stop_list)) k
  ON k.docid = d.doc_id GROUP BY d.doc_id"""

ORACLE = {
    "publications_in_month": f"WITH {_ARTICLES} SELECT publication FROM articles WHERE month = 6",
    "publication_counts_year": f"""WITH {_ARTICLES}
        SELECT publication, count(*) AS n FROM articles WHERE year = 2016 GROUP BY publication""",
    "article_count": "SELECT count(*) AS n FROM documents",
    "articles_in_month_count": f"WITH {_ARTICLES} SELECT count(*) AS n FROM articles WHERE month = 6",
    "describe_articles": f"WITH {_ARTICLES} "
    + " UNION ALL ".join(_number_row(c) for c in ("n_chars", "year", "month")),
    "describe_text_columns": f"WITH {_ARTICLES} "
    + " UNION ALL ".join(_text_row(c) for c in ("publication", "title", "text")),
    "article_preview": f"WITH {_ARTICLES} SELECT * FROM articles ORDER BY docid LIMIT 5",
    "article_records": f"""WITH {_ARTICLES}
        SELECT docid, date, text AS body FROM articles""",
    "article_titles": f"""WITH {_ARTICLES}
        SELECT docid, date, title AS body FROM articles""",
    "article_summaries": f"""WITH {_ARTICLES}
        SELECT docid, date, text AS body FROM articles""",
    "title_and_text": f"WITH {_ARTICLES} SELECT docid, title || ' ' || text AS body FROM articles",
    "has_letters": rf"""WITH {_ARTICLES}
        SELECT docid, regexp_matches(title, '\p{{L}}') AS title_has_letters FROM articles""",
    "xml_articles": f"""WITH {_ARTICLES}
        SELECT docid, date, text AS body FROM articles""",
    "xml_titles_any_depth": f"""WITH {_ARTICLES}
        SELECT docid, date, title AS body FROM articles""",
    "csv_publication_counts": f"""WITH {_ARTICLES}
        SELECT publication, count(*) AS n FROM articles WHERE year = 2016 GROUP BY publication""",
    "xml_nested_fields": f"""WITH {_ARTICLES}
        SELECT docid, date, title || ' ' || text AS body FROM articles""",
    "xml_corrupt_records": """SELECT doc_id AS docid, doc_id % 7 = 0 AS is_corrupt,
        CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS INTEGER) AS n_text FROM documents""",
    "csv_typed_articles": f"WITH {_ARTICLES} SELECT docid, publication, date, n_chars FROM articles",
    "describe_all_columns": f"WITH {_ARTICLES}, texts AS (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM articles) "
    + " UNION ALL ".join(
        _text_row(c).replace("FROM articles", "FROM texts")
        for c in ("docid", "publication", "title", "text", "n_chars", "date", "year", "month")
    ),
    "article_schema": """SELECT * FROM (VALUES ('docid', 'bigint'), ('publication', 'string'),
        ('title', 'string'), ('text', 'string'), ('n_chars', 'bigint'), ('date', 'date'), ('year', 'int'),
        ('month', 'int')) AS t(col_name, data_type)""",
    "article_bodies": f"WITH {_ARTICLES} SELECT docid, text AS body FROM articles",
    "saved_word_vectors": f"""WITH {_EMBEDDED}
        SELECT 'w' || vec_id AS word, pos, {_round('x', 6, 'value')} FROM long""",
    "vector_lines": f"""WITH {_vectors()}
        SELECT CAST(count(*) AS INTEGER) AS n, {_round('sum(value)', 6, 'total')} FROM vecs GROUP BY docid""",
    "label_lines": "SELECT CAST(doc_id % 10 AS VARCHAR) AS value FROM documents",
    "svd_certificate": f"""WITH {_WEIGHTS}
        SELECT (SELECT count(*) FROM documents) AS n, {_round('sum(weight * weight)', 6, 'squares')},
               true AS kept_is_squared_values, true AS no_row_grows, true AS vectors_are_eigenvectors,
               true AS vectors_are_orthonormal FROM weights""",
    "wide_svd_certificate": f"""WITH {_WEIGHTS.replace("LIMIT 1000", f"LIMIT {WIDE_TERMS}")}
        SELECT (SELECT count(*) FROM documents) AS n, {_round('sum(weight * weight)', 6, 'squares')},
               true AS kept_is_squared_values, true AS no_row_grows, true AS vectors_are_eigenvectors,
               true AS vectors_are_orthonormal FROM weights""",
    "counted_vectors_certificate": f"""WITH {_PAIRS}
        SELECT count(*) AS n_pairs, count(DISTINCT word) AS n_words, {_round('sum(pmi * pmi)', 5, 'squares')},
               true AS columns_are_orthogonal, true AS largest_first, true AS vectors_are_eigenvectors
        FROM informed WHERE pmi > 0""",
    "pca_certificate": f"""WITH {_vectors()},
        spread AS (SELECT pos, stddev_samp(value) AS s FROM vecs GROUP BY pos)
        SELECT (SELECT count(*) FROM documents) AS n,
               round(CAST(count(*) FILTER (WHERE s > 0) AS DOUBLE), 5) AS variance, true AS uncorrelated,
               true AS explain_their_shares, true AS largest_first FROM spread""",
    "kmeans_terms_certificate": f"""WITH {_WEIGHTS},
        by_term AS (
          SELECT sum(weight * weight) - sum(weight) * sum(weight) / (SELECT count(*) FROM documents) AS s
          FROM weights GROUP BY term_id
        )
        SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents) AS n_at_nearest,
               true AS centres_are_means, {_round('sum(s)', 4, 'all_squares')}, true AS cost_is_within
        FROM by_term""",
    "kmeans_vectors_certificate": f"""WITH {_vectors()},
        by_position AS (SELECT var_pop(value) * count(*) AS s FROM vecs GROUP BY pos)
        SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM documents) AS n_at_nearest,
               true AS centres_are_means, {_round('sum(s)', 4, 'all_squares')}, true AS cost_is_within
        FROM by_position""",
    "saved_themes": "SELECT doc_id AS docid, true AS same FROM documents",
    "plain_text": r"""SELECT doc_id AS docid,
        array_to_string(regexp_split_to_array(lower(text), '\W+'), ' ') AS plain FROM documents""",
    "kept_lemmas": _LEMMA_LINES,
    "kept_lemmas_stemmed": _STEMMED,
    "kept_lemmas_joined": _LEMMA_LINES,
    "kept_lemmas_python": _LEMMA_LINES,
    "distinct_lemmas": f"WITH {_KEPT} SELECT DISTINCT docid, lemma FROM kept",
    "term_frequency": f"""WITH {_WEIGHTS} SELECT docid, term, CAST(tf AS INTEGER) AS tf FROM counted""",
    "kept_in_article": f"""WITH {_KEPT}
        SELECT d.doc_id AS docid, CAST(count(k.lemma) AS INTEGER) AS n_lemmas
        FROM documents d LEFT JOIN kept k ON k.docid = d.doc_id GROUP BY d.doc_id""",
    "doc_frequency": f"WITH {_WEIGHTS} SELECT term, df FROM frequencies",
    "doc_frequency_top": f"WITH {_WEIGHTS} SELECT term, df FROM vocab",
    "doc_frequency_heavy": f"WITH {_WEIGHTS} SELECT term, df FROM vocab",
    "cooccurrence_counts": f"WITH {_PAIRS} SELECT word, context, n FROM counts",
    "positive_pmi": f"""WITH {_PAIRS} SELECT word, context, {_round(f'pmi - ln({PMI_SHIFT})', 6, 'pmi')}
        FROM informed WHERE pmi - ln({PMI_SHIFT}) > 0""",
    "term_index_lines": f"WITH {_WEIGHTS} SELECT '(' || term_id || ',' || term || ')' AS value FROM vocab",
    "labelled_lines": f"""WITH {_ARTICLES}
        SELECT docid || ',' || CAST(date AS VARCHAR) || ',' || (docid % 10) AS value FROM articles""",
    "term_index": f"WITH {_WEIGHTS} SELECT term_id, term, df, {_round('idf', 9, 'idf')} FROM vocab",
    "term_weights": f"WITH {_WEIGHTS} SELECT docid, term_id, {_round('weight', 9, 'weight')} FROM weights",
    "term_weights_binary": f"""WITH {_WEIGHTS}
        SELECT docid, term_id, CAST(1 AS DOUBLE) AS weight FROM weights""",
    "doc_vectors": f"WITH {_vectors()} {_LONG}",
    "doc_vectors_binary": f"WITH {_vectors('1.0::DOUBLE')} {_LONG}",
    "doc_vectors_nonzero": f"""WITH {_vectors()},
        present AS (SELECT docid FROM vecs GROUP BY docid HAVING sum(abs(value)) > 0)
        {_LONG} WHERE docid IN (SELECT docid FROM present)""",
    "concat_vectors": f"""WITH {_EMBEDDED}
        SELECT vec_id, pos, {_round('x', 6, 'value')} FROM long
        UNION ALL
        SELECT vec_id, CAST(pos + n AS INTEGER) AS pos, {_round('2 * x', 6, 'value')} FROM long""",
    "add_vectors": f"""WITH {_EMBEDDED}
        SELECT vec_id, pos, {_round('x + 0.5::DOUBLE * x', 6, 'value')} FROM long""",
    "vector_norms": f"""WITH {_EMBEDDED}
        SELECT vec_id, round(sum(abs(x)), 6) AS l1, round(sum(x * x), 6) AS from_origin
        FROM long GROUP BY vec_id""",
    "standardised": f"""WITH {_vectors()},
        columns_of AS (SELECT pos, avg(value) AS m, stddev_samp(value) AS s FROM vecs GROUP BY pos),
        z AS (
          SELECT v.docid, v.pos, CASE WHEN c.s > 0 THEN (v.value - c.m) / c.s ELSE 0.0 END AS value
          FROM vecs v JOIN columns_of c ON c.pos = v.pos
        )
        SELECT docid, pos, {_round('value', 5, 'value')} FROM z""",
    "covariance": f"""WITH {_vectors()},
        c AS (
          SELECT a.pos AS i, b.pos AS j, covar_samp(a.value, b.value) AS cov
          FROM vecs a JOIN vecs b ON a.docid = b.docid AND a.pos <= b.pos GROUP BY a.pos, b.pos
        )
        SELECT i, j, {_round('cov', 9, 'cov')} FROM c""",
    "project_on_basis": f"""WITH {_PROJECTION}
        SELECT docid, component, {_round('value', 6, 'value')} FROM projected""",
    "projection_summary": f"""WITH {_PROJECTION},
        s AS (
          SELECT component, count(*) AS count, avg(value) AS mean, var_samp(value) AS variance,
                 min(value) AS min, max(value) AS max, count(*) FILTER (WHERE value <> 0) AS nonzeros,
                 sum(abs(value)) AS norm_l1, sqrt(sum(value * value)) AS norm_l2
          FROM projected GROUP BY component
        )
        SELECT component, count, {_round('mean', 6, 'mean')}, {_round('variance', 6, 'variance')},
               {_round('min', 6, '"min"')}, {_round('max', 6, '"max"')}, nonzeros,
               {_round('norm_l1', 6, 'norm_l1')}, {_round('norm_l2', 6, 'norm_l2')}
        FROM s""",
    "assign_given_centres": f"""WITH {_DISTANCES}
        SELECT docid, cluster, {_round('distance', 6, 'distance')}
        FROM (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY round(distance, 9), cluster) AS r FROM distances)
        WHERE r = 1""",
    "labelled_by_date": f"""WITH {_ARTICLES}
        SELECT docid, date, CAST(docid % 10 AS INTEGER) AS cluster FROM articles
        ORDER BY date NULLS FIRST, docid""",
    "top_terms_per_centre": f"""WITH {_WEIGHTS},
        sizes AS (SELECT doc_id % 10 AS cluster, count(*) AS n FROM documents GROUP BY 1),
        totals AS (SELECT docid % 10 AS cluster, term_id, sum(weight) AS s FROM weights GROUP BY 1, 2),
        means AS (
          SELECT CAST(t.cluster AS INTEGER) AS cluster, t.term_id, t.s / z.n AS value
          FROM totals t JOIN sizes z ON z.cluster = t.cluster
        ),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(value, 9) DESC, term_id) AS INTEGER) AS rank
          FROM means
        )
        SELECT r.cluster, r.rank, v.term, {_round('r.value', 9, 'value')}
        FROM ranked r JOIN vocab v ON v.term_id = r.term_id WHERE r.rank <= 10""",
    "nearest_docs_per_centre": f"""WITH {_DISTANCES}
        SELECT cluster, rank, docid, {_round('distance', 6, 'distance')} FROM nearest WHERE rank <= 10""",
    "terms_of_nearest": f"""WITH {_DISTANCES},
        chosen AS (SELECT DISTINCT docid FROM nearest WHERE rank <= 10),
        ranked AS (
          SELECT docid, term_id, weight,
                 CAST(row_number() OVER (PARTITION BY docid ORDER BY round(weight, 9) DESC, term_id) AS INTEGER) AS rank
          FROM weights WHERE docid IN (SELECT docid FROM chosen)
        )
        SELECT r.docid, r.rank, v.term, {_round('r.weight', 9, 'weight')}
        FROM ranked r JOIN vocab v ON v.term_id = r.term_id WHERE r.rank <= 5""",
    "nearest_vectors_per_label": f"""WITH {_EMBEDDED},
        labelled AS (SELECT l.vec_id, l.pos, l.x, e.label FROM long l JOIN embeddings e ON e.vec_id = l.vec_id),
        centres AS (SELECT label AS cluster, pos, avg(x) AS m FROM labelled GROUP BY label, pos),
        distances AS (
          SELECT l.vec_id AS docid, c.cluster, sum((l.x - c.m) * (l.x - c.m)) AS distance
          FROM labelled l JOIN centres c ON c.pos = l.pos GROUP BY l.vec_id, c.cluster
        ),
        ranked AS (
          SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 6), docid) AS INTEGER) AS rank,
                 docid, distance
          FROM distances
        )
        SELECT cluster, rank, docid, {_round('distance', 6, 'distance')} FROM ranked WHERE rank <= 10""",
    "compare_labelings": f"WITH {_CONTINGENCY} SELECT cluster_a, cluster_b, n FROM table_ab",
    "compare_agreement": f"""WITH {_CONTINGENCY},
        of_a AS (SELECT sum(n) AS n, max(n) AS top FROM table_ab GROUP BY cluster_a),
        of_b AS (SELECT sum(n) AS n, max(n) AS top FROM table_ab GROUP BY cluster_b),
        s AS (
          SELECT (SELECT CAST(sum(n) AS BIGINT) FROM table_ab) AS n,
                 (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM table_ab) AS both_pairs,
                 (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM of_a) AS pa,
                 (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM of_b) AS pb,
                 (SELECT CAST(sum(top) AS DOUBLE) FROM of_a) AS ta,
                 (SELECT CAST(sum(top) AS DOUBLE) FROM of_b) AS tb
        ),
        e AS (SELECT *, pa * pb / (CAST(n AS DOUBLE) * (n - 1) / 2) AS expected FROM s)
        SELECT n, {_round('ta / n', 9, 'purity_a')}, {_round('tb / n', 9, 'purity_b')},
               {_round('(both_pairs - expected) / ((pa + pb) / 2 - expected)', 9, 'adjusted_rand')}
        FROM e""",
}
