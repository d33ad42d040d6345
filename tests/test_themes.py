import glob
import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from themeloom import sinks
from themeloom.functions import arrays
from themeloom.operators import clusters, compare
from themeloom.plans import staging, themes

SIZES = (40, 25, 10)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(9)
    middles = [(0, 0), (20, 0), (0, 30)]
    return np.concatenate([rng.normal(m, 1, (n, 2)) for m, n in zip(middles, SIZES)])


@pytest.fixture(scope="module")
def table(spark, points):
    rows = [(i, [float(x) for x in p], Vectors.dense(p)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, ["docid", "vec", "features"]).repartition(5)


def _labels(table):
    return {r.docid: r.cluster for r in table.collect()}


def test_clusters_are_numbered_by_size(spark, table, points, tmp_path):
    fitted = clusters.fit_themes(table, k=3)
    labels = _labels(fitted.assign(table))
    assert [labels[i] for i in range(75)] == [0] * 40 + [1] * 25 + [2] * 10
    centres = fitted.centres(spark).where("cluster = 1").orderBy("pos").collect()
    assert [r.value for r in centres] == pytest.approx(points[40:65].mean(axis=0))
    fitted.save(spark, str(tmp_path / "model"))
    fitted.save(spark, str(tmp_path / "model"))
    loaded = clusters.load_themes(spark, str(tmp_path / "model"))
    assert (loaded.matrix == fitted.matrix).all() and loaded.cost == fitted.cost
    assert _labels(loaded.assign(table)) == labels


def test_fit_repeats_whatever_the_order(table):
    one = _labels(clusters.fit_themes(table, k=6).assign(table))
    again = _labels(clusters.fit_themes(table.orderBy(F.desc("docid")).coalesce(1), k=6).assign(table))
    assert one == again


def test_equal_labels_with_two_and_eight_cores(tables):
    """A fit in two processes, with other cores and other partitions."""
    code = (
        "import sys; from bench import session; spark = session(sys.argv[1]);"
        "from __spark_entry__ import queries; import hashlib;"
        "spark.sparkContext.setCheckpointDir(sys.argv[3]);"
        "rows = [queries()[q](spark, sys.argv[2]).collect() for q in ('kmeans_terms',)];"
        "print('DIGEST', hashlib.sha256(repr(rows).encode()).hexdigest())"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = set()
    for cores in ("2", "8"):
        with tempfile.TemporaryDirectory() as folder:
            done = subprocess.run(
                [sys.executable, "-c", code, cores, tables, folder],
                cwd=root, capture_output=True, text=True,
            )
        seen.add(done.stdout.split("DIGEST ")[1].strip())
    assert len(seen) == 1


def test_equal_fits_to_the_last_bit(spark, points):
    """However the rows are cut, and with a row far larger than the others."""
    rng = np.random.default_rng(3)
    made = np.concatenate([points, rng.normal(size=(200, 2)) * 1e-3, [[1e6, -1e6]]])
    rows = [(i, Vectors.dense(p)) for i, p in enumerate(made)]
    fits = [
        clusters.fit_themes(spark.createDataFrame(rows[::turn], ["docid", "features"]).repartition(n), k=5)
        for turn, n in ((1, 1), (-1, 7), (1, 70))
    ]
    assert all((f.matrix == fits[0].matrix).all() and f.cost == fits[0].cost for f in fits)
    far = ((made[:, None, :] - fits[0].matrix[None]) ** 2).sum(axis=2)
    assert fits[0].cost == pytest.approx(far.min(axis=1).sum(), rel=1e-3)


def test_fewer_different_rows_than_clusters(spark):
    rows = [(i, Vectors.sparse(3, [i % 2], [1.0])) for i in range(10)] + [(10, Vectors.sparse(3, [], []))]
    fitted = clusters.fit_themes(spark.createDataFrame(rows, ["docid", "features"]), k=6)
    assert len(fitted.matrix) <= 3 and fitted.cost == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError):
        clusters.fit_themes(spark.createDataFrame(rows, ["docid", "features"]).limit(0))


def test_as_good_as_another_k_means(spark, table, points):
    from pyspark.ml.clustering import KMeans

    theirs = min(KMeans(k=3, seed=s).fit(table).summary.trainingCost for s in range(3))
    assert clusters.fit_themes(table, k=3, runs=3).cost == pytest.approx(theirs, rel=1e-3)


def test_more_runs_are_never_worse(table):
    one = clusters.fit_themes(table, k=6).cost
    five = clusters.fit_themes(table, k=6, runs=5).cost
    assert five <= one


def test_every_row_is_at_its_nearest_centre(spark, table):
    fitted = clusters.fit_themes(table, k=5)
    distances = clusters.squared_distances(table, fitted.centres(spark), range(5))
    assert _labels(clusters.assign(distances)) == _labels(fitted.assign(table))


def test_unit_length(spark):
    rows = [(i, Vectors.dense(a * n, b * n)) for i, (a, b, n) in enumerate(
        [(1.0, 0.0, 1), (1.0, 0.1, 90), (0.0, 1.0, 1), (0.1, 1.0, 80)])]
    table = spark.createDataFrame(rows, ["docid", "features"])
    fitted = clusters.fit_themes(table, k=2, normalise=True)
    labels = _labels(fitted.assign(clusters.unit_length(table, "features")))
    assert labels[0] == labels[1] != labels[2] == labels[3]


def test_distances_and_nearest_by_brute_force(spark, table, points):
    labels = table.select("docid", (F.col("docid") % 4).cast("int").alias("cluster"))
    centres = clusters.mean_centres(table, labels, arrays.numbered(F.col("vec")))
    means = np.array([points[c::4].mean(axis=0) for c in range(4)])
    far = ((points[:, None, :] - means[None]) ** 2).sum(axis=2)
    distances = clusters.squared_distances(table, centres, range(4))
    got = {r.docid: [d.distance for d in r.distances] for r in distances.collect()}
    assert all(got[i] == pytest.approx(far[i]) for i in range(75))
    near = clusters.nearest_articles(distances, 7)
    best = {(r.cluster, r["rank"]): r.docid for r in near.collect()}
    for c in range(4):
        order = sorted(range(75), key=lambda i: (round(far[i, c], 6), i))[:7]
        assert [best[c, n + 1] for n in range(7)] == order


def test_ties_go_to_the_smaller_number(spark):
    vectors = spark.createDataFrame([(7, [0.0]), (3, [0.0]), (5, [2.0])], "docid int, vec array<double>")
    centres = spark.createDataFrame([(0, 0, 1.0), (1, 0, -1.0)], "cluster int, pos int, value double")
    distances = clusters.squared_distances(vectors, centres, range(2))
    assert _labels(clusters.assign(distances)) == {7: 0, 3: 0, 5: 0}
    near = clusters.nearest_articles(distances, 2).where("cluster = 0").orderBy("rank").collect()
    assert [r.docid for r in near] == [3, 5]


def test_a_centre_without_a_position_counts_as_zero(spark):
    vectors = spark.createDataFrame([(1, [3.0, 4.0])], "docid int, vec array<double>")
    centres = spark.createDataFrame([(0, 0, 3.0), (1, 1, 4.0)], "cluster int, pos int, value double")
    row = clusters.squared_distances(vectors, centres, range(3)).first()
    assert [d.distance for d in row.distances] == [16.0, 9.0, 25.0]


def test_undated_articles_come_first(spark):
    articles = spark.createDataFrame(
        [(1, "2016-02-01"), (2, None), (3, "2016-01-01"), (4, "2016-02-01")], "docid int, d string"
    ).select("docid", F.col("d").cast("date").alias("date"))
    labels = articles.select("docid", (F.col("docid") * 10).alias("cluster"))
    rows = clusters.labelled_by_date(articles, labels).collect()
    assert [r.docid for r in rows] == [2, 3, 1, 4]


def test_agreement_by_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 4, 120), rng.integers(0, 3, 120)
    b[:70] = a[:70] % 3
    left = spark.createDataFrame([(i, int(x)) for i, x in enumerate(a)], "docid int, cluster int")
    right = spark.createDataFrame([(i, int(x)) for i, x in enumerate(b)], "docid int, cluster int")
    counts = compare.contingency(left, right)
    assert {(r.cluster_a, r.cluster_b): r.n for r in counts.collect()} == {
        (x, y): int(((a == x) & (b == y)).sum()) for x in range(4) for y in range(3) if ((a == x) & (b == y)).any()
    }
    same_a, same_b = a[:, None] == a, b[:, None] == b
    upper = np.triu_indices(120, 1)
    both, pa, pb = ((m[upper]).sum() for m in (same_a & same_b, same_a, same_b))
    expected = pa * pb / len(upper[0])
    row = compare.agreement(counts).first()
    assert row.n == 120
    assert row.adjusted_rand == pytest.approx((both - expected) / ((pa + pb) / 2 - expected))
    assert row.purity_a == pytest.approx(sum(np.bincount(b[a == x]).max() for x in range(4)) / 120)
    assert row.purity_b == pytest.approx(sum(np.bincount(a[b == y]).max() for y in range(3)) / 120)


def test_equal_groupings_agree_fully(spark):
    left = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "docid int, cluster int")
    assert compare.agreement(compare.contingency(left, left)).first().adjusted_rand == 1.0
    one = left.withColumn("cluster", F.lit(0))
    assert compare.agreement(compare.contingency(one, one)).first().adjusted_rand == 1.0


def test_silhouette(table):
    labelled = table.withColumn("cluster", F.when(F.col("docid") < 40, 0).when(F.col("docid") < 65, 1).otherwise(2))
    assert compare.silhouette(labelled) > 0.9


def _lines(path):
    lines = []
    for part in sorted(glob.glob(os.path.join(path, "part-*"))):
        with open(part) as f:
            lines += f.read().splitlines()
    return lines


def test_text_outputs(spark, tmp_path):
    terms = spark.createDataFrame([(0, "cat"), (1, "dog")], "term_id int, term string").coalesce(1)
    sinks.write_term_index(terms, str(tmp_path / "terms"))
    assert _lines(tmp_path / "terms") == ["(0,cat)", "(1,dog)"]
    vecs = spark.createDataFrame([(1, [0.5, -1.0])], "docid int, vec array<double>")
    sinks.write_vectors(vecs, "vec", str(tmp_path / "vecs"))
    assert _lines(tmp_path / "vecs") == ["0.5,-1.0"]
    labelled = spark.createDataFrame(
        [(3, "2016-01-01", 2), (1, None, 0)], "docid int, date string, cluster int"
    ).withColumn("date", F.col("date").cast("date"))
    for _ in range(2):
        sinks.write_labelled(clusters.by_date(labelled), str(tmp_path / "labelled"))
    assert _lines(tmp_path / "labelled") == ["1,null,0", "3,2016-01-01,2"]
    sinks.write_labels(labelled.coalesce(1), str(tmp_path / "labels"))
    assert _lines(tmp_path / "labels") == ["2", "0"]


def test_dated_lines_are_sorted_across_parts(spark, tmp_path):
    n = 5000
    labelled = spark.range(n).select(
        F.col("id").alias("docid"),
        F.date_add(F.lit("2016-01-01").cast("date"), ((F.col("id") * 37) % 300).cast("int")).alias("date"),
        (F.col("id") % 10).cast("int").alias("cluster"),
    )
    sinks.write_labelled(clusters.by_date(labelled), str(tmp_path / "out"))
    got = [(line.split(",")[1], int(line.split(",")[0])) for line in _lines(tmp_path / "out")]
    assert len(got) == n and got == sorted(got)


def test_staged_tables_go_to_the_shared_folder(spark, table):
    copy = staging.staged(table, "points")
    assert copy.schema == table.schema
    assert sorted(copy.collect()) == sorted(table.collect())
    assert staging.shared_folder(spark).rstrip("/") in copy.inputFiles()[0]


class _Session:
    """As much of a session as the choice of a folder asks for."""

    def __init__(self, master, warehouse, default="file:///"):
        self.master, self.conf, self.sparkContext, self._jsc = master, self, self, self
        self.settings = {"spark.sql.warehouse.dir": warehouse, "fs.defaultFS": default}

    def get(self, name, *default):
        return self.settings.get(name, *default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return None

    def hadoopConfiguration(self):
        return self


def test_a_folder_of_the_driver_alone_is_refused():
    for place in ("file:/home/a/spark-warehouse", "/home/a/spark-warehouse"):
        with pytest.raises(ValueError, match="checkpoint"):
            staging.shared_folder(_Session("spark://host:7077", place))
        with pytest.raises(ValueError):
            staging.shared_folder(_Session("local-cluster[2,1,1024]", place))
        assert staging.shared_folder(_Session("local[8]", place)) == place
    shared = _Session("yarn", "/user/hive/warehouse", "hdfs://names")
    assert staging.shared_folder(shared) == "/user/hive/warehouse"
    assert staging.shared_folder(_Session("yarn", "s3a://bucket/w/")) == "s3a://bucket/w"


def test_both_ways_end_to_end(spark, tables, tmp_path):
    from themeloom.plans.catalogue import LEMMAS, STOP_WORDS, _articles, _word_vectors

    articles = _articles(spark, tables)
    terms = themes.prepare(articles, LEMMAS, STOP_WORDS, num_terms=300)
    lsa = themes.lsa_way(terms, k=4)
    vecs = themes.vectors_of_articles(terms, _word_vectors(spark, tables, terms)[0])
    vectors = themes.word_vector_way(terms, vecs, k=4)
    ids = {r.docid for r in articles.select("docid").collect()}
    for result in (lsa, vectors):
        assert {r.docid for r in result.labels.collect()} == ids
        assert {r.docid for r in result.projection.collect()} == ids
        assert {f for f in result.labels.columns} == {"docid", "date", "cluster"}
    for on in ("reduced", "full"):
        reduced = themes.lsa_way(terms, k=4, on=on, normalise=True)
        assert {r.docid for r in reduced.labels.collect()} == ids
    assert sum(r.n for r in themes.compare_ways(lsa, vectors).collect()) == len(ids)
    near = themes.nearest_of(vectors.themes, vecs, 3)
    assert near.groupBy("cluster").count().where("count = 3").count() == 4

    folder = str(tmp_path / "out")
    for _ in range(2):
        themes.save_all(terms, lsa, vectors, vecs, folder)
    assert sorted(os.listdir(folder)) == [
        "article_vectors", "article_vectors.parquet", "lsa_labelled_by_date", "lsa_labels",
        "lsa_labels.parquet", "lsa_projection", "lsa_projection.parquet", "term_index",
        "word_vectors_labelled_by_date", "word_vectors_labels", "word_vectors_labels.parquet",
        "word_vectors_projection", "word_vectors_projection.parquet",
    ]
    dated = _lines(os.path.join(folder, "lsa_labelled_by_date"))
    assert len(dated) == len(ids)
    assert len(_lines(os.path.join(folder, "word_vectors_projection"))[0].split(",")) == 10
    kept = spark.read.parquet(os.path.join(folder, "lsa_projection.parquet"))
    assert {r.docid for r in kept.collect()} == ids


def test_from_xml_and_trained_word_vectors(spark, tables, tmp_path):
    from themeloom.operators import docvectors, lemmas, records
    from themeloom.plans.catalogue import LEMMAS, STOP_WORDS, _as_xml
    from themeloom.sources import articles, words

    raw = articles.read_xml(spark, _as_xml(spark, tables))
    texts = records.article_records(raw, "text")
    cut = lemmas.lemmatise(texts, LEMMAS, STOP_WORDS, body="body")
    docvectors.train_word_vectors(cut, vector_size=12, min_count=2).save(str(tmp_path / "w2v"))

    terms = themes.prepare(texts, LEMMAS, STOP_WORDS, num_terms=200, body="body")
    vecs = themes.vectors_of_articles(terms, words.read_word_vectors(spark, str(tmp_path / "w2v")))
    way = themes.word_vector_way(terms, vecs, rank=3, k=3)
    rows = way.labels.collect()
    assert len(rows) == texts.count() and {r.cluster for r in rows} == {0, 1, 2}
    assert all(len(r.projection) == 3 for r in way.projection.collect())
    assert all(r.date is not None for r in rows)


def test_clustering_needs_a_known_form(spark, tables):
    from themeloom.plans.catalogue import _terms

    with pytest.raises(ValueError):
        themes.lsa_way(_terms(spark, tables, stage=True), on="half")


def test_the_nearest_is_the_nearest_however_close(spark):
    rows = [(1, 1.6e-7), (2, 1e-8), (3, 0.0)]
    pair = F.array(F.struct(F.lit(0).alias("cluster"), F.col("distance").alias("distance")))
    distances = spark.createDataFrame(rows, "docid long, distance double").select(
        "docid", pair.alias("distances")
    )
    near = {r["rank"]: r.docid for r in clusters.nearest_articles(distances, 2).collect()}
    assert near == {1: 3, 2: 2}


def test_passes_read_packed_rows(spark):
    from pyspark.ml.linalg import Vectors
    from themeloom.operators import kmeans

    rows = [(i, Vectors.sparse(5, [i % 4, 4], [1.0 + i, -0.5])) for i in range(300)] + [(300, Vectors.sparse(5, [], []))]
    table = spark.createDataFrame(rows, ["docid", "features"]).coalesce(1)
    prepared = kmeans.rows_of(table, "features")
    (packed,) = prepared.packed.collect()
    lengths, at = np.frombuffer(packed.lengths, np.int64), np.frombuffer(packed["at"], np.int32)
    assert lengths.tolist() == [2] * 300 + [0] and at.tolist() == [p for i in range(300) for p in (i % 4, 4)]
    assert np.frombuffer(packed["values"]).tolist() == [x for i in range(300) for x in (1.0 + i, -0.5)]
    sums, counts, _ = kmeans._totals(prepared, np.zeros((1, 5)), with_sums=True)
    assert counts.tolist() == [301] and np.ldexp(sums[0].astype(float), -prepared.units.value_bits)[4] == -150.0
