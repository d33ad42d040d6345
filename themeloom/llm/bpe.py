"""BPE encoding and decoding by a trie whose nodes hold last tokens.

The encoding of a prefix of a word is the encoding of a shorter prefix and one
last token. Which token it is can be told locally: of the tokens that end the
prefix, the right one is the one that a merge of the two tokens, the last of
the shorter prefix and this one, would leave apart. So the last token of every
prefix follows from the nodes above it, and words that share a prefix share
its nodes: the states are computed once, when a node is made. The final symbol
of a word carries the end mark, so it gets a state of its own.

Every Python worker has one trie, one store of encoded words and one of pieces
of text between spaces; they are emptied when they reach a fixed size, which
costs time and changes nothing.
The vocabulary file is read by the driver and broadcast (under 2 MB), so
executors need no copy of it at that path.

Defined results: a null or empty text has no tokens and decodes to an empty
text; repeated rows give repeated rows; an empty table gives an empty table;
other columns are not read.
"""

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from themeloom.llm.rows import kept, map_batches
from themeloom.llm.trie import LONGEST, Table, Trie

MOST_WORDS = 700_000
MOST_PIECES = 1_200_000
LONGEST_STORED = 64

# The white space that no word spans, and that is one space wherever it stands.
WHITE_SPACE = (
    "\n\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters encoded at a time, words in one trie, and places for pairs of tokens already looked at.
CHARS_AT_ONCE = 4_000_000
WORDS_AT_ONCE = 40_000
PAIR_PLACES = 1 << 20


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def ascii_words(parts: dict) -> re.Pattern | None:
    """The file's word pattern for printable ASCII, where bytes stand for themselves.

    Raises an error if the file cuts words in another way than this module
    provides for: composed and lower-cased, by a pattern, then by bytes.
    """
    steps = [step["type"] for step in parts["normalizer"]["normalizers"]]
    cuts = [step["type"] for step in parts["pre_tokenizer"]["pretokenizers"]]
    if steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"]:
        raise ValueError("the vocabulary cuts words in a way that is not provided for")
    split = parts["pre_tokenizer"]["pretokenizers"][0]
    if split["behavior"] != "Removed" or not split["invert"]:
        return None
    pattern = split["pattern"]["Regex"]
    return re.compile(pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9"), re.ASCII)


class Encoder:
    """Encodes and decodes as the file's own tokenizer does."""

    def __init__(self, vocabulary: str) -> None:
        parts = json.loads(vocabulary)
        model = parts["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("not a plain BPE vocabulary")
        if parts["decoder"] is not None:
            raise ValueError("a decoder is not provided for")
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        options = ("lstrip", "rstrip", "single_word", "normalized")
        if any(token[option] for token in parts["added_tokens"] for option in options):
            raise ValueError("added tokens with options are not provided for")
        self.added = added
        longest_first = sorted(added, key=len, reverse=True)
        either = "|".join(map(re.escape, longest_first))
        self.cut = re.compile(f"({either})") if added else None
        size = max([*self.ids.values(), *added.values()]) + 1
        self.names = [""] * size
        for name, number in (self.ids | added).items():
            self.names[number] = name
        # Tokens by their text, inside a word and at its end.
        self.inner, self.final = {}, {}
        for name, number in self.ids.items():
            if self.end and name.endswith(self.end) and name != self.end:
                self.final[name[: -len(self.end)]] = number
            else:
                self.inner[name] = number
        self.longest = max(map(len, [*self.inner, *self.final]))
        # The merge of two tokens, by both; and the two that each token is made of.
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(model["merges"]):
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a << 32 | b] = rank
            self.halves.setdefault(made, (a, b, rank))
        self.left_edges = {t: self._edge(t, 0) for t in self.ids.values()}
        self.right_edges = {t: self._edge(t, 1) for t in self.ids.values()}
        self.inner_table, self.final_table = Table(self.inner), Table(self.final)
        # Pairs looked at: the pair at each place, and whether it stays apart.
        self.pair_at = np.full(PAIR_PLACES, -1, np.int64)
        self.pair_apart = np.zeros(PAIR_PLACES, bool)
        self.ascii = ascii_words(parts)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of a token, from the whole down to one symbol.

        Each comes with the rank of the merge that swallows it.
        """
        found, until = [], 1 << 60
        while True:
            found.append((token, until))
            if token not in self.halves:
                return found
            until = self.halves[token][2]
            token = self.halves[token][side]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side.

        They do not if a part at the right edge of one and a part at the left
        edge of the other have a merge that comes before both are swallowed
        by merges of their own; of equal merges the left one comes first.
        """
        for x, x_until in self.right_edges[left]:
            for y, y_until in self.left_edges[right]:
                merge = self.rank.get(x << 32 | y)
                if merge is not None and merge < x_until and merge <= y_until:
                    return False
        return True

    def pairs_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``stay_apart`` of many pairs; pairs met before are looked up."""
        keys = left << 32 | right
        places = ((left * 0x9E3779B1) ^ (right * 0x85EBCA77)) & (PAIR_PLACES - 1)
        found = self.pair_apart[places]
        missed = np.flatnonzero(self.pair_at[places] != keys)
        if len(missed):
            new, which = np.unique(keys[missed], return_inverse=True)
            apart = [self.stay_apart(key >> 32, key & 0xFFFFFFFF) for key in new.tolist()]
            found[missed] = np.array(apart, bool)[which]
            self.pair_at[places[missed]] = keys[missed]
            self.pair_apart[places[missed]] = found[missed]
            # Pairs that share a place: the one written last stays, with its own answer.
            lost = self.pair_at[places[missed]] != keys[missed]
            self.pair_at[places[missed][lost]] = -1
        return found

    def _last_tokens(
        self, trie: Trie, rows: np.ndarray, ends: np.ndarray, last: np.ndarray, table: Table
    ) -> tuple[np.ndarray, np.ndarray]:
        """Last token of the first ``ends`` symbols of the words, and the node before it.

        Longer tokens are tried first; exactly one stays apart from what is
        before it.
        """
        token = np.full(len(rows), -1, np.int64)
        before = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        for length in range(min(table.longest, int(ends.max(initial=0))), 0, -1):
            if length not in table.lengths:
                continue
            tried = open_[ends[open_] >= length]
            starts = ends[tried] - length
            found = table.find(trie.part(rows[tried], starts, length))
            hit = np.flatnonzero(found >= 0)
            tried, found = tried[hit], found[hit]
            nodes = trie.nodes[rows[tried], starts[hit]]
            fits = nodes == 0
            below = np.flatnonzero(~fits)
            fits[below] = self.pairs_apart(last[nodes[below]], found[below])
            tried, found, nodes = tried[fits], found[fits], nodes[fits]
            token[tried], before[tried] = found, nodes
            open_ = open_[token[open_] < 0]
            if not len(open_):
                break
        if len(open_):
            raise ValueError(f"the vocabulary lacks a symbol of {trie.words[rows[open_[0]]]!r}")
        return token, before

    def _store_words(self, words: list[str]) -> dict[str, bytes]:
        """Encode different words by one trie, and store them."""
        trie = Trie(words)
        last = np.full(trie.size, -1, np.int64)
        before = np.zeros(trie.size, np.int64)
        for d in range(1, trie.depth + (0 if self.end else 1)):
            rows = trie.openers(d)
            nodes = trie.nodes[rows, d]
            ends = np.full(len(rows), d)
            last[nodes], before[nodes] = self._last_tokens(
                trie, rows, ends, last, self.inner_table
            )
        every = np.arange(len(trie.words))
        if self.end:
            token, node = self._last_tokens(trie, every, trie.lengths, last, self.final_table)
            columns = [token]
        else:
            columns, node = [], trie.nodes[every, trie.lengths].astype(np.int64)
        while node.any():
            columns.append(np.where(node > 0, last[node], -1))
            node = before[node]
        backwards = np.stack(columns[::-1], axis=1)
        kept = backwards >= 0
        counts = 4 * kept.sum(axis=1)
        joined = backwards[kept].astype("<u4").tobytes()
        ends = np.cumsum(counts)
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        made = {
            word: joined[end - count : end]
            for word, end, count in zip(trie.words, ends.tolist(), counts.tolist())
        }
        self.words.update(made)
        return made

    def _long_word(self, word: str) -> bytes:
        """The same for one word beyond the length of a trie."""
        last, before = [-1], [0]
        n = len(word)
        for end in range(1, n + 1):
            table = self.final if self.end and end == n else self.inner
            for length in range(min(end, self.longest), 0, -1):
                token, start = table.get(word[end - length : end]), end - length
                if token is not None and (start == 0 or self.stay_apart(last[start], token)):
                    last.append(token)
                    before.append(start)
                    break
            else:
                raise ValueError(f"the vocabulary lacks a symbol of {word!r}")
        found = []
        while n:
            found.append(last[n])
            n = before[n]
        return pack(f"<{len(found)}I", *found[::-1])

    def _all_parts(self, pieces: list[str]) -> list[list[str]]:
        """Words of each piece, in the vocabulary's own alphabet."""
        find = self.ascii.findall if self.ascii else None
        plain = [bool(find) and p.isascii() and p.isprintable() for p in pieces]
        parts = [find(p.lower()) if own else [] for p, own in zip(pieces, plain)]
        others = [i for i, own in enumerate(plain) if not own and pieces[i]]
        # One call for many: joined by spaces, which no piece has and no word spans.
        text = self.tokenizer.normalizer.normalize_str(" ".join(pieces[i] for i in others))
        normal = text.split(" ")
        if others and len(normal) != len(others):
            raise ValueError("the vocabulary knows white space that is not provided for")
        ends = np.cumsum([len(piece) + 1 for piece in normal])
        words = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        starts = np.array([start for _, (start, _) in words], np.int64)
        of = np.searchsorted(ends, starts, side="right").tolist()
        for (word, _), i in zip(words, of):
            parts[others[i]].append(word)
        return parts

    def _encoded_words(self, words: set[str]) -> dict[str, bytes]:
        made = {word: self.words[word] for word in words if word in self.words}
        made |= {word: self._long_word(word) for word in words if len(word) > LONGEST}
        # Sorted before they are dealt out, so that shared prefixes meet.
        new = sorted(words - made.keys())
        for begin in range(0, len(new), WORDS_AT_ONCE):
            made |= self._store_words(new[begin : begin + WORDS_AT_ONCE])
        return made

    def _encoded_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different texts without white space."""
        parts = self._all_parts(pieces)
        ids_of = self._encoded_words({word for own in parts for word in own}).__getitem__
        return {piece: b"".join(map(ids_of, own)) for piece, own in zip(pieces, parts)}

    def _pieces_of(self, text: str | None) -> list[str]:
        """The text between white space; an added token is a piece of its own."""
        if not text:
            return []
        if self.cut and self.cut.search(text):
            parts = self.cut.split(text)
            return [
                piece
                for part in parts
                for piece in ([part] if part in self.added else self._pieces_of(part))
            ]
        for white in WHITE_SPACE[:5] if text.isascii() else WHITE_SPACE:
            if white in text:
                text = text.replace(white, " ")
        return text.split(" ")

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        parts = list(map(self._pieces_of, texts))
        found = [list(map(self.pieces.get, own)) for own in parts]
        new = {p for own, ids in zip(parts, found) for p, known in zip(own, ids) if known is None}
        added = {name: pack("<I", self.added[name]) for name in new & self.added.keys()}
        encoded = self._encoded_pieces(list(new - added.keys())) | added
        if len(self.pieces) + len(encoded) > MOST_PIECES:
            self.pieces.clear()
        self.pieces.update((p, ids) for p, ids in encoded.items() if len(p) <= LONGEST_STORED)
        return [
            b"".join([encoded[p] if known is None else known for p, known in zip(own, ids)])
            for own, ids in zip(parts, found)
        ]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        White space never joins, composes or matches with what is beside it,
        so the pieces between it are encoded on their own, each different one
        once.
        """
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size >= CHARS_AT_ONCE:
                yield from self._without_collector(some)
                some, size = [], 0
        yield from self._without_collector(some)

    def _without_collector(self, texts: list[str | None]) -> list[bytes]:
        # Millions of small lists and strings, and no cycles among them: looking
        # for cycles would take a good part of the time.
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._encode_some(texts)
        finally:
            if was_on:
                gc.enable()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(next(self.encode_many([text])), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, as a tokenizer without a decoder does."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def encoder_of(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, kept as long as its tasks use it."""
    name = hashlib.sha256(vocabulary.encode()).digest()
    return kept(("encoder", name), lambda: Encoder(vocabulary))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>, decoded`` of ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        encoder = encoder_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            encoded = encoder.encode_many(batch.column(1).to_pylist())
            ids = [np.frombuffer(own, "<u4") for own in encoded]
            return {
                "doc_id": batch.column(0),
                "ids": pa.array([own.astype(np.int32) for own in ids], pa.list_(pa.int32())),
                "decoded": pa.array([encoder.decode(own) for own in ids], pa.string()),
            }

        return work

    schema = "doc_id long, ids array<int>, decoded string"
    return map_batches(docs.select("doc_id", "text"), schema, make)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``doc_id, text``."""
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def make():
        encoder = encoder_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            counts, of_ids, of_texts = [], [], []
            for encoded in encoder.encode_many(batch.column(1).to_pylist()):
                decoded = encoder.decode(np.frombuffer(encoded, "<u4"))
                counts.append(len(encoded) // 4)
                of_ids.append(hashlib.sha256(encoded).hexdigest())
                of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            return {
                "doc_id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()),
                "decoded_sha256": pa.array(of_texts, pa.string()),
            }

        return work

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), schema, make)


def op5_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, vocabulary_path("word_bpe_49k.json"))
