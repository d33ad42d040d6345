"""Resampling, filter audit and exact deduplication against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest

from themeloom.llm import exactdedup, filteraudit, resampling

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
LOWER = {code: code + 32 for code in range(65, 91)}


def some_documents(n=80, seed=3):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(120)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(known, k=rng.randint(0, 60)))
        text = rng.choice([text, text.title(), text + " 50%", "É" + text.upper(), text + " x"])
        rows.append((i, text, rng.choice(["web", "web", "books", "", None])))
    rows += [(200 + i, rows[i][1], rows[i % 7][2]) for i in range(0, n, 3)]
    rows += [(300 + i, rows[i][1].swapcase(), "copies") for i in range(0, n, 5)]
    long = " ".join(rng.choices(known, k=3000))
    rows += [(400, long, "web"), (401, None, None), (402, "", "web"), (403, " \n\t", "books")]
    return rows + [(404, long, "web"), rows[5], rows[5], (None, rows[5][1], "web"), (None, None, None)]


def some_labels(rows, seed=4):
    rng = random.Random(seed)
    chosen = [i for i, _, _ in rows if i is not None and rng.random() < 0.5]
    found = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for i in dict.fromkeys(chosen)]
    return found + [(None, 1, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def rows():
    return some_documents()


def frame(spark, rows, schema=DOCS, parts=5):
    return spark.createDataFrame(rows, schema).repartition(parts)


def as_set(table):
    return Counter(tuple(row) for row in table.collect())


# Importance resampling.


def features_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(" ".join(run).encode()) for run in runs]


def resampled(rows, target, buckets=10_000, percent=5, least=20):
    own = [features_of(text) for _, text, *_ in rows]
    s = Counter(f % buckets for _, fs in own for f in fs)
    t = Counter(f % buckets for text in target for f in features_of(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    found = []
    for (doc_id, *_), (n, fs) in zip(rows, own):
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
            for b in (f % buckets for f in fs)
        )
        name = f"42:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        found.append([doc_id, len(fs), weight, score, None, n])
    fit = [row for row in found if row[5] >= least]
    fit.sort(key=lambda row: (-row[3], -1 if row[0] is None else row[0]))
    for rank, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[4] = rank
    return Counter(tuple(row[:5]) for row in found)


TARGET = ["abc de fgh abc", "Abc de; fgh", None, ""]


@pytest.mark.parametrize("margin", [0.005, 0.0001, 0.9])
def test_resampling_as_by_hand(spark, rows, margin):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    scored = resampling.score_documents(frame(spark, rows), target)
    drawn = resampling.draw(scored, percent=40, margin=margin)
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    assert as_set(drawn.select(*columns)) == resampled(rows, TARGET, percent=40)


def test_resampling_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    target = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    found = resampling.op11_importance_resampling(spark, tables)
    assert as_set(found) == resampled([(r.doc_id, r.text) for r in docs], target)


def test_resampling_draws_exactly_among_ties(spark):
    rows = [(7, "a b " * 20, "x")] * 50 + [(8, "a b " * 20, "x")] * 50
    target = spark.createDataFrame([], "text string")
    drawn = resampling.draw(resampling.score_documents(frame(spark, rows), target), percent=30)
    ranks = [r["rank"] for r in drawn.collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, 31))


def test_resampling_of_nothing(spark):
    target = spark.createDataFrame([], "text string")
    empty = spark.createDataFrame([], DOCS)
    assert resampling.draw(resampling.score_documents(empty, target)).count() == 0


def test_crc_of_joined_words():
    rng = random.Random(1)
    words = [bytes(rng.choices(range(256), k=rng.choice([1, 5, 63, 64, 65, 200, 5000]))) for _ in range(60)]
    of = np.repeat(np.arange(3), 20)
    wanted = [
        (zlib.crc32(b" ".join(words[i : i + n])), of[i])
        for n in (1, 2, 3)
        for i in range(len(words) - n + 1)
        if of[i] == of[i + n - 1]
    ]
    found = [(int(c), o) for crcs, owner in resampling.features(words, of, 0) for c, o in zip(crcs, owner)]
    assert found == wanted


def test_long_texts_in_blocks(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["ab", "c", "É", "x" * 40], k=k)).encode() for k in (3, 500, 0, 1, 90)]

    def counted():
        return Counter(
            (int(c), int(o))
            for block in resampling._blocks(texts)
            for crcs, owner in resampling.features(*block)
            for c, o in zip(crcs, owner)
        )

    whole = counted()
    monkeypatch.setattr(resampling, "AT_ONCE", 64)
    assert counted() == whole


# Filter audit.


def audit_by_hand(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    failed = {}
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * (i is not None and i > first[text])
        failed.setdefault(source or "", []).append((fails, i in good, i in toxic))
    found = {}
    for part, docs in failed.items():
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                stay = [d for d in left if name not in d[0]]
                fails = sum(name in d[0] for d in docs)
                shapley[name] += len(gone)
                found[part, order, step] = [
                    len(stay), len(gone), fails - len(gone), sum(d[0] == name for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
                left = stay
        for order in map("".join, permutations("ABCDE")):
            for step, name in enumerate(order, 1):
                found[part, order, step].append(shapley[name])
    return {key: tuple(value) for key, value in found.items()}


def test_audit_as_by_hand(spark, rows):
    labels = some_labels(rows)
    # Longer texts, so that filter A lets some through.
    longer = [(i, t and " ".join([t] * 5), s) for i, t, s in rows]
    for docs in (rows, longer):
        report = filteraudit.audit(frame(spark, docs), frame(spark, labels, LABELS, 2))
        found = {tuple(row[:3]): tuple(row[3:]) for row in report.collect()}
        assert found == audit_by_hand(docs, labels)


def test_audit_with_small_groups_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(filteraudit, "AT_ONCE", 50)
    texts = [(t or "").encode() for _, t, _ in rows]
    assert [filteraudit.word_counts(t) for t in texts] == [
        (len(t.split()), len(set(t.split()))) for t in texts
    ]


def test_packed_sums_do_not_run_over():
    outcomes = filteraudit.packed_outcomes()
    times = 1 << 40
    sums = [times * sum(outcomes), 0, 0]
    figures = filteraudit.step_rows(sums)
    once = filteraudit.step_rows([sum(outcomes), 0, 0])
    assert all((figures[name] == times * once[name]).all() for name in once)
    assert (figures["kept"][:, -1] == times).all()


def test_audit_ignores_other_columns_and_takes_empty_tables(spark, rows):
    docs = frame(spark, [(*r, 1, "x") for r in rows], DOCS + ", part int, Digest string")
    labels = frame(spark, [(*r, 5) for r in some_labels(rows)], LABELS + ", good int", 2)
    plain = filteraudit.audit(frame(spark, rows), labels.drop("good"))
    assert as_set(filteraudit.audit(docs, labels)) == as_set(plain)
    nothing = spark.createDataFrame([], DOCS)
    assert filteraudit.audit(nothing, labels).count() == 0
    assert filteraudit.audit(docs, spark.createDataFrame([], LABELS)).agg({"good_lost": "sum"}).first()[0] == 0


# Exact deduplication.


def copies_by_hand(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(-1 if i is None else i)
    found = Counter()
    for key, ids in groups.items():
        sha = hashlib.sha256(key.encode()).digest()
        keep, left = max(ids), 1
        for i in ids:
            kept = i == keep and left
            left -= bool(kept)
            found[None if i < 0 else i, None if keep < 0 else keep, len(ids), bool(kept), sha] += 1
    return found


@pytest.mark.parametrize("bits, marks", [(64, 27), (4, 27), (4, 3), (64, 1)])
def test_exact_groups_as_by_hand(spark, rows, bits, marks):
    """With few bits nearly all texts share fingerprints, and bytes decide."""
    found = exactdedup.exact_groups(frame(spark, rows), marks, bits)
    assert {(*k[:4], bytes(k[4])): n for k, n in as_set(found).items()} == copies_by_hand(rows)


def test_exact_groups_of_one_text(spark):
    rows = [(i, "Same", "x") for i in range(3000)] + [(None, "same", "x")] * 3
    found = exactdedup.exact_groups(frame(spark, rows, parts=20)).collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(2999, 3003)}
    assert [r.doc_id for r in found if r.kept] == [2999]


def test_exact_groups_of_nothing(spark):
    assert exactdedup.exact_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(0)
    for segment_bits in (6, 9):
        prints = rng.integers(0, 1 << 62, 5000, np.uint64) % np.uint64(1 << 50)
        prints |= np.uint64(3 << (64 - segment_bits))
        own = prints[rng.integers(0, 5000, 20_000)]
        parts = [np.unique(p, return_counts=True) for p in np.array_split(own, 7)]
        again = []
        for some, counts in parts:
            kept = exactdedup.filter_of(some, counts, segment_bits)
            back = exactdedup.fingerprints_of(kept, 3, segment_bits)
            assert (back == some).all()
            again.append((back, np.frombuffer(kept["counts"], "<i8")))
        merged, counts = exactdedup.merged(again)
        wanted, times = np.unique(own, return_counts=True)
        assert (merged == wanted).all() and (counts == times).all()


@pytest.mark.parametrize("operator", [exactdedup, filteraudit])
def test_sql_with_nulls_and_repeated_rows(spark, rows, operator):
    """The SQL and the operator agree where the given tables have no such rows."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    labels = some_labels(rows)
    con.execute("CREATE TABLE labels(doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    if operator is exactdedup:
        wanted = Counter((*r[:4], bytes.fromhex(r[4])) for r in con.execute(operator.OP13_SQL).fetchall())
        found = operator.exact_groups(frame(spark, rows))
        assert {(*k[:4], bytes(k[4])): n for k, n in as_set(found).items()} == wanted
    else:
        found = operator.audit(frame(spark, rows), frame(spark, labels, LABELS, 2))
        assert as_set(found) == Counter(con.execute(operator.OP12_SQL).fetchall())
