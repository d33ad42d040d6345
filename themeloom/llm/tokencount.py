"""Token counts under a unigram model, by dynamic programming on a trie.

The best segmentation of a text into pieces maximises the sum of the pieces'
scores. Texts are cut into pre-tokens (a word with the spaces before it, or a
line end), which no piece spans. The different pre-tokens of a batch go into a
trie, and the forward score of a node (best score of any segmentation of that
prefix, and its number of pieces) is computed once from the nodes above it.
Terminal counts are stored, so a text only adds up the counts of its
pre-tokens.

Pieces come from a public vocabulary. Its file ranks pieces and gives no
probabilities, so the score of rank r is taken from Zipf's law, ``-log(r + 2)``
in millionths as a whole number; sums are then exact and ties real. Of equal
scores the fewest pieces win. A character that is no piece costs more than any
piece and counts as its UTF-8 bytes.

Defined results: a null or empty text has no tokens; a space is put before
the text, as the vocabulary expects; repeated rows give repeated rows; an
empty table gives an empty table; other columns are not read.
"""

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from themeloom.llm.bpe import vocabulary_path
from themeloom.llm.rows import kept, map_batches
from themeloom.llm.trie import LONGEST, Table, Trie

SPACE = "▁"
MILLION = 1_000_000

# Stored counts of pre-tokens; characters, and pre-tokens in one trie, at a time.
MOST_STORED = 400_000
CHARS_AT_ONCE = 4_000_000
WORDS_AT_ONCE = 40_000

# Score and number of pieces are one whole number, score x ROOM - pieces.
ROOM = 1 << 12


@dataclass(frozen=True)
class Pieces:
    """Scores of pieces, and the score of a character that is none."""

    scores: dict[str, int]
    unknown: int


def read_pieces(path: str) -> Pieces:
    """Pieces of a vocabulary file in rank order, with scores by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        if len(piece) <= LONGEST and "\n" not in piece and SPACE not in piece.lstrip(SPACE):
            scores[piece] = -round(MILLION * math.log(len(scores) + 2))
    return Pieces(scores, -round(MILLION * (math.log(len(scores) + 2) + 10)))


def pre_tokens(text: str) -> list[str]:
    """The parts of a text that no piece spans; together they are the text.

    Spaces belong to the word after them; line ends stand alone.
    """
    found: list[str] = []
    for number, line in enumerate(text.split("\n")):
        if number:
            found.append("\n")
        words = line.split(" ")
        spaces = "" if number else SPACE
        for i, word in enumerate(words):
            if i:
                spaces += SPACE
            if word:
                found.append(spaces + word)
                spaces = ""
        if spaces:
            found.append(spaces)
    return found


class TokenCounter:
    """Counts the tokens of pre-tokens."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        values = {piece: score * ROOM - 1 for piece, score in pieces.scores.items()}
        self.values = values
        self.table = Table(values)
        self.stored: dict[str, int] = {}

    def _unknown(self, char: str) -> int:
        return self.pieces.unknown * ROOM - len(char.encode("utf-8", "surrogatepass"))

    def long_word(self, word: str) -> int:
        """Tokens of one pre-token by the plain recurrence, whatever its length."""
        tokens, score = [0], [0]
        longest = self.table.longest
        for end in range(1, len(word) + 1):
            best = None
            for start in range(max(0, end - longest), end):
                own = self.pieces.scores.get(word[start:end])
                if own is not None:
                    new = (score[start] + own, -(tokens[start] + 1))
                    best = new if best is None or new > best else best
            char = word[end - 1]
            if char not in self.pieces.scores:
                n = len(char.encode("utf-8", "surrogatepass"))
                new = (score[end - 1] + self.pieces.unknown, -(tokens[end - 1] + n))
                best = new if best is None or new > best else best
            score.append(best[0])
            tokens.append(-best[1])
        return tokens[-1]

    def _by_trie(self, words: list[str]) -> dict[str, int]:
        trie = Trie(words)
        forward = np.zeros(trie.size, np.int64)
        for d in range(1, trie.depth + 1):
            rows = trie.openers(d)
            best = np.full(len(rows), np.iinfo(np.int64).min)
            for length in sorted(n for n in self.table.lengths if n <= d):
                starts = np.full(len(rows), d - length)
                hashes = trie.part(rows, starts, length)
                at = np.minimum(
                    np.searchsorted(self.table.hashes, hashes), len(self.table.hashes) - 1
                )
                met = np.flatnonzero(self.table.hashes[at] == hashes)
                before = forward[trie.nodes[rows[met], d - length]]
                best[met] = np.maximum(best[met], before + self.table.numbers[at[met]])
                if length == 1:
                    for i in np.flatnonzero(self.table.hashes[at] != hashes).tolist():
                        char = trie.words[rows[i]][d - 1]
                        before = int(forward[trie.nodes[rows[i], d - 1]])
                        best[i] = max(int(best[i]), before + self._unknown(char))
            forward[trie.nodes[rows, d]] = best
        ends = forward[trie.nodes[np.arange(len(trie.words)), trie.lengths]]
        return dict(zip(trie.words, ((-ends) % ROOM).tolist()))

    def _known(self, words: set[str]) -> dict[str, int]:
        made = {word: self.stored[word] for word in words if word in self.stored}
        made |= {word: self.long_word(word) for word in words if len(word) > LONGEST}
        new = sorted(words - made.keys())
        for begin in range(0, len(new), WORDS_AT_ONCE):
            some = self._by_trie(new[begin : begin + WORDS_AT_ONCE])
            if len(self.stored) + len(some) > MOST_STORED:
                self.stored.clear()
            self.stored.update(some)
            made |= some
        return made

    def count_many(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Pre-tokens and tokens of each text."""
        found, some, size = [], [], 0
        for i, text in enumerate(texts):
            some.append(pre_tokens(text) if text else [])
            size += len(text or "")
            if size >= CHARS_AT_ONCE or i == len(texts) - 1:
                tokens = self._known(set().union(*some)).__getitem__
                found += [(len(own), sum(map(tokens, own))) for own in some]
                some, size = [], 0
        return found


def _digest(pieces: Pieces) -> bytes:
    """Tells two sets of pieces apart, by their names and scores."""
    return hashlib.sha256(repr((pieces.unknown, [*pieces.scores.items()])).encode()).digest()


def token_counts(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """``doc_id, n_pre_tokens, n_tokens`` of ``doc_id, text``.

    The pieces (some 30,000) are broadcast; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    name = _digest(pieces)

    def make():
        counter = kept(("token counter", name), lambda: TokenCounter(shared.value))

        def work(batch: pa.RecordBatch) -> dict:
            counted = counter.count_many(batch.column(1).to_pylist())
            return {
                "doc_id": batch.column(0),
                "n_pre_tokens": pa.array([pair[0] for pair in counted], pa.int64()),
                "n_tokens": pa.array([pair[1] for pair in counted], pa.int64()),
            }

        return work

    schema = "doc_id long, n_pre_tokens long, n_tokens long"
    return map_batches(docs.select("doc_id", "text"), schema, make)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, read_pieces(vocabulary_path("piece_bpe_32k.model")))
