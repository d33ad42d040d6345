"""Queries and operators against brute force on small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from themeloom.llm import classlm, htmltext, linededup, neighbours, packing, quality, simhash
from themeloom.llm.bpe import vocabulary_path

DOCS = "doc_id long, text string"
LOWER = {code: code + 32 for code in range(65, 91)}
SHARED = "Read and accept the TERMS of this site before you go on"


def words(text):
    return re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))


def write(spark, folder, table, rows, schema):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    frame.write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
    return str(folder)


def some_documents(n=60, seed=5):
    """Prose with shared lines, copies, near copies, nulls and empty texts."""
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(150)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choices(known, k=rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([SHARED, f"\t{SHARED.upper()} \r"]))
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, rows[i][1]) for i in range(0, n, 9)]
    long = " ".join(rng.choices(known, k=4000))
    rows += [(200, long), (201, long + " end"), (202, None), (203, ""), (204, " \n\t"), (205, "ÉÀ\n\n")]
    return rows


# Class-based language model.


def test_language_model_base_and_counts(spark, tmp_path):
    rows = some_documents()
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    found = {row.doc_id: row for row in classlm.op3_class_lm(spark, folder).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*words(text), None] for i, text in rows}
    counts = Counter(t for i, own in tokens.items() if not held[i] for t in own)
    whole = sum(counts.values())
    assert set(found) == set(tokens)
    for i, own in tokens.items():
        row = found[i]
        base = sum(math.log10((counts[t] + 0.5) / (whole + 0.5 * (len(counts) + 1))) for t in own)
        assert (row.held_out, row.n_tokens) == (held[i], len(own))
        assert (row.n_known, row.train_tokens) == (sum(counts[t] > 0 for t in own), whole)
        assert row.base_score == pytest.approx(base, rel=1e-9)
        assert row.score < 0 and math.isfinite(row.score)


def test_language_model_scores_by_the_classes(spark):
    rows = some_documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model, _, _ = classlm.fit(docs)
    classes = dict(zip(model.words, model.classes.tolist()))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*words(text), classlm.END] for i, text in rows}
    counts = Counter(t for i, own in tokens.items() if not held[i] for t in own)
    assert {w for w, c in classes.items() if c < classlm.CLASSES} == {w for w, n in counts.items() if n >= 3}

    def class_of(word):
        return classes.get(word, classlm.ending(word))

    size, vocabulary, pairs = Counter(), Counter(), Counter()
    for word, n in counts.items():
        size[class_of(word)] += n
        vocabulary[class_of(word)] += 1
    for i, own in tokens.items():
        if not held[i]:
            pairs.update(zip(map(class_of, [classlm.END, *own]), map(class_of, own)))
    share = {c: size[c] + 0.5 for c in range(classlm.SIZE)}
    share = {c: n / sum(share.values()) for c, n in share.items()}
    followers, sums = Counter(c for c, _ in pairs), Counter()
    for (c, _), n in pairs.items():
        sums[c] += n

    def score(before, word):
        c, d, n = class_of(before), class_of(word), counts[word]
        s = followers[c] + 1
        move = (pairs[c, d] + s * share[d]) / (sums[c] + s)
        word_in = n / size[d] if d < classlm.CLASSES else (n + 0.5) / (size[d] + 0.5 * (vocabulary[d] + 1))
        return math.log10(move) + math.log10(word_in)

    for row in classlm.score_documents(docs).collect():
        own = tokens[row.doc_id]
        assert row.score == pytest.approx(sum(map(score, [classlm.END, *own], own)), rel=1e-9)


def test_gain_of_a_move_is_the_change_of_the_likelihood(monkeypatch):
    monkeypatch.setattr(classlm, "SIZE", 6)
    rng = np.random.default_rng(3)
    text = rng.integers(0, 9, 400)
    classes = rng.integers(0, 6, 9)

    def pairs_under(of):
        made = np.zeros((6, 6))
        np.add.at(made, (of[text[:-1]], of[text[1:]]), 1)
        return made

    before_move = classlm.likelihood(pairs_under(classes))
    for word in range(9):
        ahead, behind = np.zeros(6), np.zeros(6)
        left, right = text[:-1], text[1:]
        np.add.at(ahead, classes[right[(left == word) & (right != word)]], 1)
        np.add.at(behind, classes[left[(right == word) & (left != word)]], 1)
        twice = float(((left == word) & (right == word)).sum())
        got = classlm.gains(int(classes[word]), ahead, behind, twice, classlm.ClassPairs(pairs_under(classes)))
        for c in range(6):
            moved = classes.copy()
            moved[word] = c
            assert got[c] == pytest.approx(classlm.likelihood(pairs_under(moved)) - before_move, abs=1e-6)


def test_gains_of_many_words_are_those_of_each(monkeypatch):
    monkeypatch.setattr(classlm, "MOST_LAID_OUT", 3000)
    rng = np.random.default_rng(5)
    n_words, size = 60, classlm.SIZE
    own, twice = rng.integers(0, classlm.CLASSES, n_words), rng.integers(0, 3, n_words).astype(float)
    ahead, behind = (rng.poisson(rng.random((n_words, 1)) ** 3, (n_words, size)).astype(float) for _ in "ab")
    ahead[0], behind[1] = 0.0, 0.0
    pairs = rng.integers(0, 9, (size, size)).astype(float)
    for word in range(n_words):
        pairs[own[word]] += ahead[word]
        pairs[:, own[word]] += behind[word]
        pairs[own[word], own[word]] += twice[word]
    together = classlm.gains_of_words(own, ahead, behind, twice, classlm.ClassPairs(pairs))
    before_move = classlm.likelihood(pairs)
    for word in range(n_words):
        without = pairs.copy()
        without[own[word]] -= ahead[word]
        without[:, own[word]] -= behind[word]
        without[own[word], own[word]] -= twice[word]
        for c in (0, int(own[word]), classlm.CLASSES - 1):
            moved = without.copy()
            moved[c] += ahead[word]
            moved[:, c] += behind[word]
            moved[c, c] += twice[word]
            assert together[word, c] == pytest.approx(classlm.likelihood(moved) - before_move, abs=1e-6)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_language_model_beats_single_words_on_held_out(spark, tables, scale):
    tables = tables.replace("sf0.001", scale)
    rows = [row for row in classlm.op3_class_lm(spark, tables).collect() if row.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_of_nothing(spark):
    assert classlm.score_documents(spark.createDataFrame([], DOCS)).count() == 0


# Line deduplication.


def dedup_brute(rows, least=5):
    def key(line):
        stripped = line.strip(" \t\n\v\f\r").translate(LOWER)
        return stripped if len(stripped) >= 40 else None

    split = [(i, (text or "").split("\n")) for i, text in rows]
    held = Counter(k for _, lines in split for k in {key(line) for line in lines} if k)
    keeper = {}
    for i, lines in split:
        for k in {key(line) for line in lines} - {None}:
            keeper[k] = max(keeper.get(k, -math.inf), -math.inf if i is None else i)
    out = []
    for i, lines in split:
        own = -math.inf if i is None else i
        kept = [x for x in lines if not (k := key(x)) or held[k] < least or keeper[k] == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def by_row(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("filter_bits", [linededup.FILTER_BITS, linededup.SEGMENT_BITS])
def test_lines_as_brute_force(spark, filter_bits):
    rows = some_documents()
    rows += [rows[0], rows[0], (None, rows[0][1]), (None, None)]
    found = linededup.dedup_lines(spark.createDataFrame(rows, DOCS), filter_bits=filter_bits)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()]
    assert by_row(got) == by_row(dedup_brute(rows))
    assert sum(r[3] for r in got) > 5


def test_lines_as_sql(spark, tmp_path):
    rows = some_documents()
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        expected = db.execute(linededup.OP4_SQL).fetchall()
    got = [tuple(row) for row in linededup.op4_line_dedup(spark, folder).collect()]
    assert sorted(got) == sorted(expected)


def test_lines_keep_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x", None)], f"{DOCS}, n_lines string, digest string")
    row = linededup.dedup_lines(docs).first()
    assert (row.text, row.n_lines, row.n_dropped, row.digest) == ("a", 1, 0, None)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# SimHash.


def print_of(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(len(own) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_brute(rows):
    prints = [print_of(text) for _, text in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                label[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest[top(i)] = min(smallest.get(top(i), doc_id), doc_id)
    return sorted((d, f"{p:016x}", smallest[top(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def near_copies():
    rng = random.Random(2)
    rows = some_documents(30)
    for i in range(12):
        changed = rows[i][1].split(" ")
        changed[rng.randrange(len(changed))] = "new"
        rows.append((300 + i, " ".join(changed)))
    chain = [str(n) for n in range(3000)]
    for i in range(10):
        rows.append((400 + i, " ".join(chain[i * 3 :])))
    return rows


def test_simhash_as_brute_force(spark, tmp_path):
    rows = near_copies()
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    assert sorted(map(tuple, simhash.op9_simhash(spark, folder).collect())) == components_brute(rows)


def test_simhash_crowded_buckets_give_the_same(spark):
    rows = near_copies()
    found = simhash.near_duplicates(spark.createDataFrame(rows, DOCS), most_in_bucket=1).collect()
    got = sorted((r.doc_id, f"{r.fingerprint % 2**64:016x}", r.component_id) for r in found)
    assert got == components_brute(rows)


def test_covering_masks_meet_every_pair_within_the_radius():
    masks, rng = simhash.covering_masks(), random.Random(1)
    for _ in range(3000):
        flipped = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(mask & flipped == 0 for mask in masks)


def test_simhash_keeps_one_of_each_group(spark):
    rows = [*near_copies(), (None, None), (202, None)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], f"{DOCS}, group_id string")
    kept = simhash.keep_first(docs)
    expected = {component for _, _, component in components_brute([r for r in rows if r[0] is not None])}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    assert simhash.keep_first(docs.limit(0)).count() == 0


# Packing.


def fewest(lengths, capacity):
    best = len(lengths)

    def put(at, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if at == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[at]:
                left = list(rooms)
                left[left.index(room)] -= lengths[at]
                put(at + 1, left)
        put(at + 1, [*rooms, capacity - lengths[at]])

    put(0, [])
    return best


def test_packing_is_optimal_on_small_input():
    rng = random.Random(8)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        found = packing._bins(packing.complete(dict(Counter(lengths)), 20))
        assert found == fewest(lengths, 20), lengths


@pytest.mark.parametrize(
    "source", ["<div>x" * 40_000, "<b>x" * 40_000, "<i><h1>x" * 20_000, "<div></span>x" * 40_000]
)
def test_deep_pages_are_read_in_linear_memory(source):
    # A quadratic parser would need minutes and gigabytes for these.
    page = htmltext.parse(source)
    assert sum(len(block.text) for block in page.blocks) == source.count("x")
    path = page.paths.text(page.elements[-1].path)
    assert page.paths.find(path) == page.elements[-1].path
    assert htmltext.extract(source, [path]).endswith("x")


def test_quotes_in_bare_attribute_values():
    assert htmltext.extract("<p class=it's>one</p><p>it's two</p>", []) == "one\nit's two"
    assert htmltext.extract("<p title='a>b' id = \"c>d\">one</p>", []) == "one"
    assert htmltext.parse('<div class="a>b">x</div>').paths.find(">div.a#b") is not None
    assert htmltext.parse("").paths.find(">div") is None


def test_quality_fit_is_bounded(spark):
    long_text = " ".join(f"w{i}" for i in range(64 * 1000))
    rows = [(1, f"text {i}") for i in range(50)] + [(2, long_text), (3, None), (3, "x"), (None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    sample = quality.training_sample(docs, labels).collect()
    kept = [i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(row["_id"] for row in sample) == kept
    assert [r["_id"] for r in quality.training_sample(docs, labels).collect()].count(1) <= 1
    bag = quality.passages(long_text)
    some = quality.spaced(bag)
    assert len(bag) == 1000 and len(some) == quality.MOST_PASSAGES and some[0] == bag[0]
    assert quality.spaced(bag[:7]) == bag[:7]


def fewest_by_subsets(lengths, capacity):
    """Sequences needed, by the fewest sequences and least fill of every subset."""
    best = [(1, 0)] + [None] * (2 ** len(lengths) - 1)
    for subset in range(1, len(best)):
        ways = []
        for i, n in enumerate(lengths):
            if subset >> i & 1:
                bins, fill = best[subset ^ 1 << i]
                ways.append((bins, fill + n) if fill + n <= capacity else (bins + 1, n))
        best[subset] = min(ways)
    return best[-1][0]


def test_packing_is_optimal_where_the_bound_is_not_met():
    known = [58, 50, 44, 34, 25, 22, 20, 19, 17, 11]
    assert packing._bins(packing.complete(dict(Counter(known)), 100)) == 3
    rng, open_ones = np.random.default_rng(5), 0
    for i in range(600):
        low, high = ((8, 65), (15, 50))[i % 2]
        lengths = rng.integers(low, high, rng.integers(6, 14)).tolist()
        counts = dict(Counter(lengths))
        found = packing.complete(counts, 100)
        assert Counter(n for f in found for n in f.lengths * f.times) == counts
        assert all(sum(f.lengths) <= 100 for f in found)
        if packing._bins(found) > packing.lower_bound(counts, 100):
            open_ones += 1
            assert packing._bins(found) == fewest_by_subsets(lengths, 100), lengths
    assert open_ones > 10


def test_all_undominated_fillings_are_found():
    ways = set(packing.fillings(100, {60: 1, 41: 2, 40: 1, 30: 2, 29: 1, 10: 1}))
    assert {(60, 40), (41, 30, 29), (41, 41, 10)} <= ways
    # A longer one takes the place of one, of two, or of none.
    assert not {(60, 29, 10), (60, 30, 10), (40, 30, 30), (41, 41)} & ways
    assert list(packing.fillings(100, {100: 1, 60: 1, 40: 1})) == [(100,)]
    assert list(packing.fillings(5, {6: 3})) == [()]


def check_packed(rows, packed):
    theirs = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    theirs.no_truncation()
    theirs.no_padding()
    expected = []
    for i, text in rows:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            expected.append((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed]
    assert by_row(got) == by_row(expected)
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    tokens = sum(r.length for r in packed)
    assert len(places) >= math.ceil(tokens / 2048)
    return len(places) - math.ceil(tokens / 2048)


def test_packing_places_every_token_once(spark, tmp_path):
    rows = [*some_documents(), (None, "a b"), (1, some_documents()[1][1])]
    folder = write(spark, tmp_path, "documents", rows, DOCS)
    assert check_packed(rows, packing.op7_best_fit_packing(spark, folder).collect()) <= 1


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.pack_documents(empty, vocabulary_path("word_bpe_49k.json")).count() == 0


# Nearest neighbours.


def vectors(n=700, width=12):
    rng = np.random.default_rng(4)
    made = rng.normal(size=(n, width)).round(1)
    made[made == 0] = 0.1
    made[50:90] = made[40]
    rows = [(i, made[i].tolist()) for i in range(n)]
    rows[20] = (20, None)
    rows[21] = (21, [0.0] * width)
    rows[22] = (22, [float("nan")] + [1.0] * (width - 1))
    rows[23] = (23, [None] + [1.0] * (width - 1))
    rows[24] = (24, [1.0])
    return [*rows, rows[100], (None, rows[5][1])], made


def test_neighbours_as_brute_force(spark, tmp_path):
    rows, made = vectors()
    schema = "vec_id long, embedding array<double>"
    folder = write(spark, tmp_path, "embeddings", rows, schema)
    out = [i for i in range(len(made)) if not 20 <= i <= 24]
    for_query = {}
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    for row in neighbours.search(embeddings, share=1.0).collect():
        for_query.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(for_query) == [i for i in out if i % 20 == 0]
    for query, found in for_query.items():
        scores = {i: float(np.cumsum(made[i] * made[query])[-1]) for i in out if i != query}
        expected = sorted(scores, key=lambda i: (-scores[i], i))[:20]
        assert [i for _, i, _ in sorted(found)] == expected
        assert [rank for rank, _, _ in sorted(found)] == list(range(1, 21))
        assert all(score == pytest.approx(scores[i], abs=1e-12) for _, i, score in found)


@pytest.mark.parametrize("n", [600, 6000])
def test_neighbours_through_the_index(spark, tmp_path, n):
    """Evenly spread vectors, which have no near cells: 19 in 20 of the nearest, scores exact."""
    made = np.random.default_rng(n).normal(size=(n, 64))
    made /= np.linalg.norm(made, axis=1)[:, None]
    folder = write(spark, tmp_path, "embeddings", list(enumerate(made.tolist())), "vec_id long, embedding array<double>")
    found = {}
    for row in neighbours.op2_inverted_multi_index(spark, folder).collect():
        found.setdefault(row.query_id, []).append(row)
    assert sorted(found) == list(range(0, n, 20))
    met = 0
    for query, rows in found.items():
        scores = np.cumsum(made * made[query], axis=1)[:, -1]
        assert len(rows) == 20 and all(row.score == scores[row.vec_id] for row in rows)
        best = np.lexsort((np.arange(n), -scores))
        met += len({row.vec_id for row in rows} & set(best[best != query][:20].tolist()))
    assert neighbours.share_for(n) < 0.7 and met >= 0.93 * 20 * len(found)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, score string"
    few = spark.createDataFrame([(0, [1.0, 2.0], "a"), (20, [1.0, 0.5], "b")], schema)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(few).collect())
    assert got == [(0, 1, 20, 2.0), (20, 1, 0, 2.0)]
    assert neighbours.search(few.limit(0)).count() == 0


# HTML.


def page(body):
    return f"<html><head><title>No</title></head><body><nav><a href=/>Menu</a></nav>{body}<footer>End</footer></body>"


def test_pages(spark, tmp_path):
    main = "<div class='story-{}'><h1>A &amp; B</h1><p>One\n  two <b>three</b></p><p>Caf&eacute;</div>"
    junk = "<script>var a='<p>x</p>';</script><div class='comments'><p>Me too</p></div><form>Go</form>"
    rows = [(i, "http://a.example/x", page(main.format(i) + junk)) for i in range(6)]
    text = "A & B\nOne two three\nCafé"
    rows += [(10, None, None), (11, "http://a.example/y", ""), (12, "no url", "plain"), rows[0]]
    folder = write(spark, tmp_path, "pages", rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in htmltext.op6_html_extraction(spark, folder).collect())
    expected = [(i, text, len(text)) for i in (0, 0, 1, 2, 3, 4, 5)]
    assert got == [*expected, (10, "", 0), (11, "", 0), (12, "plain", 5)]


def test_no_pages_and_other_columns(spark):
    schema = "page_id long, url string, html string, host string, text string"
    rows = [(1, "http://b.example", page("<article><p>Yes</p></article>"), "x", "y")]
    pages = spark.createDataFrame(rows, schema)
    assert htmltext.extract_pages(pages).first().text == "Yes"
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


# Quality.


def test_quality_on_held_out_documents(spark, tables):
    folder = tables.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("the given tables are not here")
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    found = quality.op8_quality_mil(spark, folder).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r.predicted == label[r.doc_id] for r in found if r.held_out and r.doc_id in label]
    assert sum(held) >= 0.9 * len(held) > 0


def test_quality_sample_is_the_smallest_hashes(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS quality")
    got = quality.training_sample(docs, labels, 20).collect()
    hashes = {r.id: r.h for r in spark.range(400).selectExpr("id", "xxhash64(id) AS h").collect()}
    for label in (0, 1):
        own = [i for i in hashes if (i % 3 == 0) == label and zlib.crc32(str(i).encode()) % 4 != 2]
        assert {r._id for r in got if r.label == label} == set(sorted(own, key=hashes.get)[:20])
        assert {r.n for r in got if r.label == label} == {len(own)}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "c", None)], f"{DOCS}, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 5)], "doc_id long, quality int")
    scored = quality.score_documents(docs, quality.fit(docs, labels)).collect()
    assert [r.score for r in scored] == [0.5] * 3
    assert quality.score_documents(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_quality_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = ["good words here now " * 40, "bad !!! ### 1234 " * 40] * 20
    bags = [quality.features(quality.passages(t)) for t in texts]
    model = quality.train(bags, np.array([1.0, 0.0] * 20), np.ones(40))
    long = quality.passages(" ".join(rng.choice(["good", "bad", "###", "now"], 5000)))
    whole = model.score(long)
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    assert model.score(long)[0] == pytest.approx(whole[0], rel=1e-9)
    assert model.score(long)[1] == whole[1]


# The pipeline.


def test_pipeline_as_brute_force(spark, tables):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{tables}/documents.parquet").to_pylist()}
    good = [r.doc_id for r in quality.op8_quality_mil(spark, tables).collect() if r.predicted]
    deduped = [(i, text) for i, text, _, _ in dedup_brute([(i, rows[i]) for i in good])]
    firsts = {component for _, _, component in components_brute(deduped)}
    kept = [(i, text) for i, text in deduped if i in firsts]
    check_packed(kept, corpus_pipeline.run(spark, tables).collect())


def test_pipeline_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    row = docs.where("text IS NOT NULL").first()
    assert row.n_chars == len(row.text) and len(hashlib.sha256(row.text.encode()).hexdigest()) == 64


CLASHING = ("score", "predicted", "top_passage", "N_LINES", "n_dropped", "_loser", "_copy", "Score2", "carried", "a b.c")


def test_pipeline_stages_carry_any_columns(spark, tables):
    """Also with names the operators use themselves, nulls and repeated rows."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(60)
    docs = docs.union(docs.limit(5)).union(
        spark.createDataFrame([(None, None, None, None, None), (None, "", "x", None, 0)], docs.schema)
    )
    docs = docs.withColumns({name: F.col("doc_id") + i for i, name in enumerate(CLASHING)})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        for row in docs.collect():
            assert all(row[name] == (row.doc_id + i if row.doc_id is not None else None) for i, name in enumerate(CLASHING))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert packed.count() >= docs.count() > 0


def test_pipeline_stages_take_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_lines_lost_by_look_up_and_by_join(spark, monkeypatch):
    rows = some_documents() + [(None, f"{SHARED}\nmore"), (None, SHARED), (7, SHARED)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    sent = by_row(map(tuple, linededup.dedup_lines(docs).collect()))
    monkeypatch.setattr(linededup, "MOST_SENT", 0)
    joined = by_row(map(tuple, linededup.dedup_lines(docs).collect()))
    assert sent == joined == by_row(dedup_brute(rows))
