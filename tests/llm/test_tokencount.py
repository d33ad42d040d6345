import math

import pytest

from themeloom.llm import tokencount as t
from themeloom.llm.bpe import vocabulary_path

WORDS = {"▁a": -5, "a": -4, "▁": -3, "ab": -6, "b": -4, "ba": -7, "▁▁": -5, "aba": -9, "é": -8}
PIECES = t.Pieces({k: v * t.MILLION for k, v in WORDS.items()}, -30 * t.MILLION)


def by_whole_text(text, pieces):
    """The best segmentation of a whole text, without pre-tokens and trie."""
    if not text:
        return 0
    text = t.SPACE + text.replace(" ", t.SPACE)
    best = [(0, 0)]
    for end in range(1, len(text) + 1):
        found = [
            (best[start][0] + pieces.scores[text[start:end]], best[start][1] - 1)
            for start in range(max(0, end - 40), end)
            if text[start:end] in pieces.scores
        ]
        if text[end - 1] not in pieces.scores:
            n = len(text[end - 1].encode())
            found.append((best[end - 1][0] + pieces.unknown, best[end - 1][1] - n))
        best.append(max(found))
    return -best[-1][1]


TEXTS = ["", "a", "ab aba", "  abab  ba ", "\n", "a\n\nb a\n", "xéx éé", "abababab" * 20, "😀 a"]


@pytest.mark.parametrize("text", TEXTS)
def test_whole_text_has_the_same_best(text):
    counter = t.TokenCounter(PIECES)
    assert counter.count_many([text])[0][1] == by_whole_text(text, PIECES)


def test_real_pieces_over_a_table(spark, tables):
    pieces = t.read_pieces(vocabulary_path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: r.n_tokens for r in t.token_counts(docs, pieces).collect()}
    rows = docs.select("doc_id", "text").limit(25).collect()
    assert len(got) == docs.count()
    assert all(got[r.doc_id] == by_whole_text(r.text, pieces) for r in rows)


def test_scores_follow_ranks():
    pieces = t.read_pieces(vocabulary_path("piece_bpe_32k.model"))
    first = next(iter(pieces.scores.values()))
    assert first == -round(t.MILLION * math.log(2))
    assert pieces.unknown < min(pieces.scores.values())


def test_shared_prefixes_and_long_words_agree():
    counter = t.TokenCounter(PIECES)
    words = {"▁a", "▁ab", "▁aba", "▁abab", "▁b", "b", "ba", "bab"}
    made = counter._by_trie(sorted(words))
    assert made == {word: counter.long_word(word) for word in words}


def test_edge_rows(spark):
    rows = [(1, None, 2), (None, "a b", 3), (1, None, 2), (4, "", 5), (5, "ab" * 100_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = t.token_counts(docs, PIECES).collect()
    assert sorted((r.n_tokens for r in got if r.doc_id != 5)) == [0, 0, 0, 3]
    assert len(got) == 5
    assert t.token_counts(docs.limit(0), PIECES).collect() == []


def test_two_sets_of_pieces_of_the_same_names(spark):
    other = t.Pieces(PIECES.scores | {"ab": -t.MILLION, "aba": -30 * t.MILLION}, PIECES.unknown)
    docs = spark.createDataFrame([(1, "abab aba")], "doc_id long, text string")
    found = [t.token_counts(docs, pieces).first().n_tokens for pieces in (PIECES, other, PIECES)]
    assert found == [by_whole_text("abab aba", p) for p in (PIECES, other, PIECES)]
    assert found[0] != found[1]
