"""Scores of a class-based n-gram language model (Brown et al., 1992).

The probability of a word after another is that of its class after the other's
class, times that of the word in its class. The model learns from the
documents that are not held out.

1. Words are counted over all training texts (one row per word and task, then
   one per word).
2. The ``HEAD`` most frequent words get numbers. Documents are written once as
   numbers, with the rarer words beside them.
3. Words of the head with at least ``FEWEST`` tokens are put into ``CLASSES``
   classes by exchange: in each round every word of one half is moved, in
   parallel, to the class that raises the likelihood of all class pairs most
   (after Uszkoreit and Brants, 2008). The contexts of a word are one row, with
   all words beside it; a round passes over these rows with the present
   classes. All other words are in ``ENDINGS`` classes by their endings: put
   where their one or two contexts fit best, they score worse on other texts.
4. Class pairs are counted over all training documents.
5. A document is scored from its numbers; only counts of its rarer words are
   joined, so the table of counts is never broadcast.

What goes through the driver follows from settings alone: HEAD words with
their classes, and the square of the number of classes.

Probabilities: a word in an exchanged class has its share of the class. In a
class by ending it has ``(c + 0.5) / (n + 0.5 (v + 1))``, where the class has n
tokens and v words; a word without a count stands for the one unseen word. A
class after another has ``(pairs + S p) / (n + S)`` with p the class's share
and S one more than the different classes that follow the other (Witten and
Bell, 1991), so that few documents lean on shares and many on pairs.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as the text ``null``; repeated rows are counted and scored each; without
training documents all shares are those of nothing seen; an empty table gives
an empty table; other columns are not read.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.quality import remainder
from themeloom.llm.rows import map_batches, utf8
from themeloom.plans.staging import staged

# The end token holds white space, so it is no word.
END = "\n"

HEAD = 150_000
FEWEST = 3
CLASSES = 64
ENDINGS = 64
SIZE = CLASSES + ENDINGS
ROUNDS = 8

# Different words that a task holds before it sends their counts.
MOST_HELD = 300_000
# Tokens whose pairs are counted at once; a longer document is taken by itself.
MOST_TOKENS = 4_000_000
# Numbers of class pairs that are laid out at once.
MOST_LAID_OUT = 250_000


def is_held_out(doc_id):
    return remainder(doc_id, 5) == 1


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z in lower case, then the end token.

    Both methods of bytes know ASCII only, so other white space is part of words.
    """
    return [*(text or b"").lower().split(), END.encode()]


def ending(word: str) -> int:
    """The class of a rarer word, by its last two characters."""
    return CLASSES + zlib.crc32(word[-2:].encode()) % ENDINGS


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            made = {
                "word": pa.array(list(held.keys()), pa.binary()).cast(pa.string()),
                "n": pa.array(list(held.values()), pa.int64()),
            }
            held.clear()
            return pa.RecordBatch.from_pydict(made)

        for batch in batches:
            for text in utf8(batch.column(0)):
                held.update(words_of(text))
                if len(held) > MOST_HELD:
                    yield sent()
        yield sent()

    parts = texts.select("text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Everything that scoring needs but the counts of rarer words."""

    words: list[str]
    counts: np.ndarray  # of the head, by number
    classes: np.ndarray  # of the head, by number
    total: int
    different: int
    class_tokens: np.ndarray = field(default_factory=lambda: np.zeros(0))
    class_words: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def end(self) -> int:
        """The number of the end token, which stands before every first word."""
        return self.words.index(END) if END in self.words else len(self.words) + ending(END)

    def class_of_id(self) -> np.ndarray:
        """Classes of the head, then of the ids that stand for classes."""
        return np.concatenate([self.classes, np.arange(SIZE)]).astype(np.int64)

    def log_moves(self) -> np.ndarray:
        """log10 of the probability of a class (column) after another (row)."""
        share = (self.class_tokens + 0.5) / (self.class_tokens + 0.5).sum()
        followers = (self.pairs > 0).sum(axis=1, keepdims=True) + 1.0
        after = self.pairs + followers * share
        return np.log10(after / after.sum(axis=1, keepdims=True))

    def log_rarer(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the probability of words in their classes by ending."""
        n, v = self.class_tokens[classes], self.class_words[classes]
        return np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))

    def log_head(self) -> np.ndarray:
        exchanged = self.classes < CLASSES
        found = np.zeros(len(self.words))
        own = self.class_tokens[self.classes]
        found[exchanged] = np.log10(self.counts[exchanged] / own[exchanged])
        found[~exchanged] = self.log_rarer(self.counts[~exchanged], self.classes[~exchanged])
        return found

    def log_base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.different + 1)))


def numbered(docs: DataFrame, words: list[str]) -> DataFrame:
    """``row, doc_id, held_out, ids binary, rarer array<string>``, staged.

    ``ids`` has one int32 per token; rarer words have the number of the head
    plus their class by ending, and stand in ``rarer`` in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    n_head = len(words)

    def make():
        number = {word.encode(): i for i, word in enumerate(shared.value)}

        def work(batch: pa.RecordBatch) -> dict:
            ids, rarer = [], []
            for text in utf8(batch.column(2)):
                tokens = words_of(text)
                own = np.array(list(map(number.get, tokens, repeat(-1))), "<i4")
                at = np.flatnonzero(own < 0)
                rare = [tokens[i].decode() for i in at.tolist()]
                own[at] = [n_head + ending(word) for word in rare]
                ids.append(own.tobytes())
                rarer.append(rare)
            return {
                "doc_id": batch.column(0),
                "held_out": batch.column(1),
                "ids": pa.array(ids, pa.binary()),
                "rarer": pa.array(rarer, pa.list_(pa.string())),
            }

        return work

    schema = "doc_id long, held_out boolean, ids binary, rarer array<string>"
    read = docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text")
    made = map_batches(read, schema, make).withColumn("row", F.monotonically_increasing_id())
    return staged(made, "numbered-documents")


def token_runs(batch: pa.RecordBatch, end: int) -> Iterator[np.ndarray]:
    """Ids of many documents in a row. Each ends with the end token, so that
    one stands before every document once another opens the run."""
    opening = np.array([end], "<i4").tobytes()
    some, size = [opening], 0
    for ids in batch.column(0).to_pylist():
        some.append(ids)
        size += len(ids) // 4
        if size >= MOST_TOKENS:
            yield np.frombuffer(b"".join(some), "<i4")
            some, size = [opening], 0
    if size:
        yield np.frombuffer(b"".join(some), "<i4")


def _counts(keys: np.ndarray, name: str) -> pa.RecordBatch:
    at, n = np.unique(keys, return_counts=True)
    return pa.RecordBatch.from_pydict(
        {name: pa.array(at.astype(np.int64)), "n": pa.array(n.astype(np.int64))}
    )


def neighbours(documents: DataFrame, model: Model, exchanged: int) -> DataFrame:
    """``word, after, n_after, before, n_before``: what stands beside a word.

    One row per exchanged word: the numbers of the next words and how often
    each is next, and the same for the words before. Each is packed into one
    binary value (int32 numbers, int64 counts), as the rows are read in every
    round. A word that is not exchanged has the number ``exchanged`` plus its
    place among the classes by ending.
    """
    of_id = model.class_of_id() - CLASSES + exchanged
    of_id[:exchanged] = np.arange(exchanged)
    shared = documents.sparkSession.sparkContext.broadcast(of_id)
    end, numbers = model.end(), exchanged + ENDINGS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids in token_runs(batch, end):
                own = shared.value[ids]
                left, right = own[:-1], own[1:]
                either = (left < exchanged) | (right < exchanged)
                yield _counts(left[either] * numbers + right[either], "pair")

    train = documents.where("NOT held_out").select("ids")
    pairs = train.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    left, right = F.expr(f"pair div {numbers}"), F.expr(f"pair % {numbers}")
    # Twice the word, and one more for what stands after it.
    ahead = F.struct((left * 2 + 1).alias("key"), right.alias("other"), "n")
    behind = F.struct((right * 2).alias("key"), left.alias("other"), "n")
    both = pairs.select(F.explode(F.array(ahead, behind)).alias("side")).select("side.*")
    own = both.where(F.col("key") < 2 * exchanged)
    sides = own.repartition(F.expr("key div 2")).sortWithinPartitions("key")
    schema = "word long, after binary, n_after binary, before binary, n_before binary"
    return staged(sides.mapInArrow(_pack_words, schema), "word-neighbours")


def _pack_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word of rows ``key, other, n`` in the order of ``key``."""
    kinds = ("<i8", "<i4", "<i8")
    held = [np.zeros(0, kind) for kind in kinds]
    for batch in batches:
        new = [column.to_numpy().astype(kind) for column, kind in zip(batch.columns, kinds)]
        held = [np.concatenate(pair) for pair in zip(held, new)]
        # The last word may go on in the next batch.
        cut = int(np.searchsorted(held[0], held[0][-1] // 2 * 2)) if len(held[0]) else 0
        if cut:
            yield _packed(*(own[:cut] for own in held))
            held = [own[cut:] for own in held]
    if len(held[0]):
        yield _packed(*held)


def _packed(keys: np.ndarray, others: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    words = np.unique(keys // 2)
    made = {"word": pa.array(words)}
    for name, key in [("after", words * 2 + 1), ("before", words * 2)]:
        begins, ends = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
        spans = list(map(slice, begins.tolist(), ends.tolist()))
        made[name] = pa.array([others[span].tobytes() for span in spans], pa.binary())
        made[f"n_{name}"] = pa.array([n[span].tobytes() for span in spans], pa.binary())
    return pa.RecordBatch.from_pydict(made)


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(x + (x == 0))


class ClassPairs:
    """Counts of all class pairs, with what the gains of moves are made of."""

    def __init__(self, n: np.ndarray) -> None:
        self.n, self.logs = n.astype(np.float64), _x_log_x(n)
        self.rows, self.columns = self.n.sum(axis=1), self.n.sum(axis=0)
        self.corner = np.diag(self.n)


def gains(
    own: int, after: np.ndarray, before: np.ndarray, twice: float, pairs: ClassPairs
) -> np.ndarray:
    """Change of the likelihood when a word moves from class ``own`` to each exchanged class.

    ``after[c]`` and ``before[c]`` count words of class c beside it, without
    itself; ``twice`` counts it beside itself.
    """
    return gains_of_words(np.array([own]), after[None], before[None], np.array([twice]), pairs)[0]


def gains_of_words(
    own: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, pairs: ClassPairs
) -> np.ndarray:
    """``gains`` of many words, a row each.

    Only the columns and rows of classes beside a word are looked at; words
    beside which there are as many classes are worked on together.
    """
    a, b = after[:, :CLASSES], before[:, :CLASSES]
    ahead = _side_gains(own, after, b, twice, pairs.n[:CLASSES].T, pairs.logs[:CLASSES].T)
    behind = _side_gains(own, before, a, twice, pairs.n[:, :CLASSES], pairs.logs[:, :CLASSES])
    # Its neighbours' rows and columns have the word, whatever its class.
    n_after, n_before = after.sum(axis=1) + twice, before.sum(axis=1) + twice
    word = np.arange(len(own))
    rows = np.tile(pairs.rows[:CLASSES], (len(own), 1))
    columns = np.tile(pairs.columns[:CLASSES], (len(own), 1))
    corner = np.tile(pairs.corner[:CLASSES], (len(own), 1))
    rows[word, own] -= n_after
    columns[word, own] -= n_before
    corner[word, own] -= after[word, own] + before[word, own] + twice
    # Likelihood with the word in class c, up to terms that are the same for all c.
    both = _x_log_x(corner + a + b + twice[:, None]) - _x_log_x(corner + a)
    both = both - _x_log_x(corner + b) + _x_log_x(corner)
    sums = _x_log_x(rows + n_after[:, None]) - _x_log_x(rows)
    sums = sums + _x_log_x(columns + n_before[:, None]) - _x_log_x(columns)
    value = ahead + behind + both - sums
    return value - value[word, own][:, None]


def _side_gains(
    own: np.ndarray,
    beside: np.ndarray,
    other: np.ndarray,
    twice: np.ndarray,
    n: np.ndarray,
    logs: np.ndarray,
) -> np.ndarray:
    """What the pairs with classes on one side of each word gain, by the word's class.

    ``beside`` counts that side, ``other`` the exchanged classes of the other.
    A row of ``n`` and ``logs`` has the pairs of a class of that side.
    """
    gained = np.zeros((len(own), n.shape[1]))
    different = (beside > 0).sum(axis=1)
    for k in np.unique(different[different > 0]).tolist():
        of_size = np.flatnonzero(different == k)
        most = max(MOST_LAID_OUT // (k * CLASSES), 1)
        for begin in range(0, len(of_size), most):
            some = of_size[begin : begin + most]
            word, mine = np.arange(len(some)), own[some]
            near = np.nonzero(beside[some])[1].reshape(len(some), k)
            counts = beside[some[:, None], near]
            # The class pairs without the word; they change in its own row and column only.
            pairs, pair_logs = n[near], logs[near]
            pairs[word, :, mine] -= counts
            at, place = np.nonzero(near == mine[:, None])
            pairs[at, place] -= other[some[at]]
            pairs[at, place, mine[at]] -= twice[some[at]]
            pair_logs[word, :, mine] = _x_log_x(pairs[word, :, mine])
            pair_logs[at, place] = _x_log_x(pairs[at, place])
            pairs += counts[:, :, None]
            gained[some] = (_x_log_x(pairs) - pair_logs).sum(axis=1)
    return gained


def likelihood(pairs: np.ndarray) -> float:
    rows, columns = pairs.sum(axis=1), pairs.sum(axis=0)
    return float(_x_log_x(pairs).sum() - _x_log_x(rows).sum() - _x_log_x(columns).sum())


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _ends(column: pa.Array) -> list[int]:
    """Where the numbers of each row end."""
    return np.cumsum([len(own) // 4 for own in column.to_pylist()]).tolist()


def _beside(
    words: np.ndarray, others: np.ndarray, n: np.ndarray, ends: list[int], classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """How often each class stands on one side of each word, and the word itself."""
    row = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    itself = others == words[row]
    counted = np.bincount(
        row[~itself] * SIZE + classes[others[~itself]], n[~itself], len(words) * SIZE
    )
    twice = np.bincount(row[itself], n[itself], len(words))
    return counted.reshape(len(words), SIZE), twice


def better_classes(sides: DataFrame, of: np.ndarray, pairs: np.ndarray) -> list:
    """``word, best`` of words that another class suits better; at most HEAD rows."""
    shared = sides.sparkSession.sparkContext.broadcast((of, ClassPairs(pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, all_pairs = shared.value
        for batch in batches:
            words = batch.column(0).to_numpy()
            after, n_after = _joined(batch.column(1), "<i4"), _joined(batch.column(2), "<i8")
            before, n_before = _joined(batch.column(3), "<i4"), _joined(batch.column(4), "<i8")
            # Classes beside the words; a word beside itself is counted apart.
            ahead, twice = _beside(words, after, n_after, _ends(batch.column(1)), classes)
            behind, _ = _beside(words, before, n_before, _ends(batch.column(3)), classes)
            own = classes[words]
            value = gains_of_words(own, ahead, behind, twice, all_pairs)
            best = value.argmax(axis=1)
            moves = value[np.arange(len(words)), best] > 1e-9
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words[moves]), "best": pa.array(best[moves].astype(np.int64))}
            )

    return sides.mapInArrow(run, "word long, best long").collect()


def pairs_of_sides(sides: DataFrame, of: np.ndarray, exchanged: int) -> np.ndarray:
    """Class pairs with at least one exchanged word under the classes ``of``."""
    shared = sides.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, counted = shared.value, np.zeros(SIZE * SIZE)
        for batch in batches:
            own = classes[batch.column(0).to_numpy()] * SIZE
            lengths = np.diff(_ends(batch.column(1)), prepend=0)
            near = classes[_joined(batch.column(1), "<i4")]
            n = _joined(batch.column(2), "<i8")
            counted += np.bincount(np.repeat(own, lengths) + near, n, SIZE * SIZE)
            # Other words have no row, so their pairs are counted from here too.
            before = _joined(batch.column(3), "<i4")
            lengths = np.diff(_ends(batch.column(3)), prepend=0)
            own = np.repeat(own // SIZE, lengths)[before >= exchanged]
            near = classes[before[before >= exchanged]] * SIZE
            n = _joined(batch.column(4), "<i8")[before >= exchanged]
            counted += np.bincount(near + own, n, SIZE * SIZE)
        yield _pair_counts(counted)

    return _collected(sides.mapInArrow(run, "at long, n long"))


def _pair_counts(counted: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counted)
    return pa.RecordBatch.from_pydict(
        {"at": pa.array(at, pa.int64()), "n": pa.array(counted[at].astype(np.int64), pa.int64())}
    )


def _collected(parts: DataFrame) -> np.ndarray:
    """Sums of counts of class pairs, as a square."""
    made = np.zeros(SIZE * SIZE)
    for row in parts.groupBy("at").agg(F.sum("n").alias("n")).collect():
        made[row["at"]] = row.n
    return made.reshape(SIZE, SIZE)


def exchange(sides: DataFrame, exchanged: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each exchanged word.

    It starts from words dealt by rank. Words move in halves, so that two that
    attract each other do not change places; a round that does not raise the
    likelihood is taken back.
    """
    endings = CLASSES + np.arange(ENDINGS)
    of = np.concatenate([np.arange(exchanged) % CLASSES, endings])
    pairs = pairs_of_sides(sides, of, exchanged)
    value = likelihood(pairs)
    for step in range(rounds):
        half = sides.where(F.col("word") % 2 == step % 2)
        new = of.copy()
        for row in better_classes(half, of, pairs):
            new[row.word] = row.best
        if (new == of).all():
            continue
        new_pairs = pairs_of_sides(sides, new, exchanged)
        new_value = likelihood(new_pairs)
        if new_value > value:
            of, pairs, value = new, new_pairs, new_value
    return of[:exchanged]


def class_pairs(documents: DataFrame, model: Model) -> np.ndarray:
    """How often each class follows each, over all training documents."""
    shared = documents.sparkSession.sparkContext.broadcast(model.class_of_id())
    end = model.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(SIZE * SIZE)
        for batch in batches:
            for ids in token_runs(batch, end):
                of = shared.value[ids]
                counted += np.bincount(of[:-1] * SIZE + of[1:], minlength=SIZE * SIZE)
        yield _pair_counts(counted)

    train = documents.where("NOT held_out").select("ids")
    return _collected(train.mapInArrow(run, "at long, n long"))


def class_sizes(counts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words of each class."""
    shared = counts.sparkSession.sparkContext.broadcast(
        dict(zip(model.words, model.classes.tolist()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        tokens, words = np.zeros(SIZE, np.int64), np.zeros(SIZE, np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            of = np.array([known[w] if w in known else ending(w) for w in names], np.int64)
            tokens += np.bincount(of, batch.column(1).to_numpy(), SIZE).astype(np.int64)
            words += np.bincount(of, minlength=SIZE)
        yield pa.RecordBatch.from_pydict(
            {
                "class": pa.array(np.arange(SIZE), pa.int64()),
                "tokens": pa.array(tokens, pa.int64()),
                "words": pa.array(words, pa.int64()),
            }
        )

    rows = counts.mapInArrow(run, "class long, tokens long, words long")
    rows = rows.groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    tokens, words = np.zeros(SIZE), np.zeros(SIZE)
    for row in rows.collect():
        tokens[row["class"]], words[row["class"]] = row.tokens, row.words
    return tokens, words


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the numbered documents, and the table ``word, n`` of counts."""
    train = docs.where(~is_held_out(F.col("doc_id")))
    counts = staged(word_counts(train), "word-counts")
    sums = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("different")).first()
    head = counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()
    words = [row.word for row in head]
    documents = numbered(docs, words)
    n_of = np.array([row.n for row in head], np.float64)
    endings = np.array([ending(word) for word in words], np.int64)
    model = Model(words, n_of, endings, int(sums.total or 0), int(sums.different))
    exchanged = int((n_of >= FEWEST).sum())
    if exchanged:
        sides = neighbours(documents, model, exchanged)
        model.classes[:exchanged] = exchange(sides, exchanged)
    model.class_tokens, model.class_words = class_sizes(counts, model)
    model.pairs = class_pairs(documents, model)
    return model, documents, counts


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    model, documents, counts = fit(docs)
    n_head, end = len(model.words), model.end()
    tables = (
        model.class_of_id(),
        np.concatenate([model.log_head(), np.zeros(SIZE)]),
        np.concatenate([model.log_base(model.counts), np.zeros(SIZE)]),
        model.log_moves(),
    )
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    weight = model.class_tokens + 0.5 * (model.class_words + 1)
    weights = docs.sparkSession.sparkContext.broadcast(weight)

    def make():
        of_id, emit, base, moves = shared.value
        first = int(of_id[end])

        def work(batch: pa.RecordBatch) -> dict:
            n, known, bases, scores = [], [], [], []
            for ids in batch.column(3).to_pylist():
                own = np.frombuffer(ids, "<i4")
                of = of_id[own]
                before = np.concatenate([[first], of[:-1]])
                n.append(len(own))
                known.append(int((own < n_head).sum()))
                bases.append(float(base[own].sum()))
                scores.append(float(moves[before, of].sum() + emit[own].sum()))
            return {
                "row": batch.column(0),
                "doc_id": batch.column(1),
                "held_out": batch.column(2),
                "n_tokens": pa.array(n, pa.int64()),
                "head_known": pa.array(known, pa.int64()),
                "head_base": pa.array(bases, pa.float64()),
                "head_score": pa.array(scores, pa.float64()),
            }

        return work

    schema = (
        "row long, doc_id long, held_out boolean, n_tokens long, head_known long, "
        "head_base double, head_score double"
    )
    head = map_batches(documents.select("row", "doc_id", "held_out", "ids"), schema, make)

    # Rarer words: each with its count, and its class's weight by the ending.
    def make_sums():
        own = weights.value

        def work(batch: pa.RecordBatch) -> dict:
            words = batch.column(1).to_pylist()
            c = batch.column(2).to_numpy()
            weight = own[np.array([ending(word) for word in words], np.int64)]
            return {
                "row": batch.column(0),
                "n": pa.array((c > 0).astype(np.int64), pa.int64()),
                "base": pa.array(model_base(c), pa.float64()),
                "score": pa.array(np.log10((c + 0.5) / weight), pa.float64()),
            }

        return work

    total, different = model.total, model.different

    def model_base(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (total + 0.5 * (different + 1)))

    rarer = documents.select("row", F.explode("rarer").alias("word"))
    met = rarer.join(counts, "word", "left").select(
        "row", "word", F.coalesce("n", F.lit(0)).alias("n")
    )
    sums = map_batches(met, "row long, n long, base double, score double", make_sums)
    sums = sums.groupBy("row").agg(
        F.sum("n").alias("rare_known"),
        F.sum("base").alias("rare_base"),
        F.sum("score").alias("rare_score"),
    )
    zero = F.lit(0)
    return head.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("head_base") + F.coalesce("rare_base", zero)).alias("base_score"),
        (F.col("head_score") + F.coalesce("rare_score", zero)).alias("score"),
    )


def op3_class_lm(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
