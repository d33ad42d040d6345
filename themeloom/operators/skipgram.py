"""Word vectors trained as skip-grams with hierarchical softmax (Mikolov et al., 2013).

The method, its window, rates and the mean over tasks are those of Spark's
Word2Vec. There each word of a text is taken by itself, by tasks that share
one array, and the driver collects all vectors. Here a task has its own
arrays and takes a few words at once, all their contexts in one product; what
it sends is averaged by blocks of words, on the executors.

The driver holds the words with their counts, and the tree of their codes; a
task holds some twenty bytes a word, and the two vectors of each of the ``HELD``
most frequent. Vectors of rarer words wait in a file of the task while its texts
are without them, so that memory does not grow with the vectors there are.
"""

import json
import os
import tempfile
import time
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators.batches import AT_ONCE, in_pieces
from themeloom.plans.staging import staged

# As in Spark: words to either side, longest sentence, and the first and least rate.
WINDOW = 5
LONGEST = 1000
RATE = 0.025
LEAST_RATE = RATE * 1e-4

# Tokens that are laid out at once, those that learn from the same vectors, and words
# of a block of vectors.
TOKENS = 4000
STEP = 48
BLOCK = 1024

# Words, and nodes of the tree, whose vectors a task holds in memory.
HELD = 1 << 17


@dataclass(frozen=True)
class WordVectors:
    """Trained vectors: a staged table ``word, vector array<float>``, and how they were made."""

    table: DataFrame
    params: dict

    def getVectors(self) -> DataFrame:
        """``word, vector`` as Spark's model gives them."""
        return self.table.select("word", array_to_vector(F.col("vector").cast("array<double>")).alias("vector"))

    def save(self, path: str) -> None:
        """Written as Spark's ``Word2VecModel`` is, whose ``load`` reads it."""
        spark = self.table.sparkSession
        about = {
            "class": "org.apache.spark.ml.feature.Word2VecModel", "timestamp": int(time.time() * 1000),
            "sparkVersion": spark.version, "uid": f"w2v_{spark.sparkContext.applicationId}",
            "paramMap": self.params, "defaultParamMap": {},
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(path + "/metadata")
        self.table.write.parquet(path + "/data")


def word_counts(lemmas: DataFrame) -> DataFrame:
    """``word, n`` of all lemmas; null lists and null lemmas are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            counted = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], ["word", "n"])

    parts = lemmas.select("lemmas").mapInArrow(run, "word string, n long")
    return parts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))


def huffman(counts: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each node of the tree, its parent and whether it is the second child.

    ``counts`` descend. Leaves are the words, inner nodes follow them by weight,
    and the root is the last one.
    """
    n = len(counts)
    weights = array("q", counts)
    parent, second = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, bool)
    leaf, inner = n - 1, n
    for made in range(n, 2 * n - 1):
        weights.append(0)
        for child in (0, 1):
            if leaf >= 0 and (inner == made or weights[leaf] < weights[inner]):
                least, leaf = leaf, leaf - 1
            else:
                least, inner = inner, inner + 1
            weights[made] += weights[least]
            parent[least], second[least] = made, child
    return parent, second


def paths(
    parent: np.ndarray, second: np.ndarray, words: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes above each word and the label at each, flat, and where each word's begin.

    Nodes are numbered from the root, which is 0, so that those of frequent
    words come first. All words are meant if none are given.
    """
    root = len(parent) - 1
    at = np.arange(root // 2 + 1) if words is None else words
    n, of = len(at), np.arange(len(at))
    owners, nodes, labels = [], [], []
    while True:
        going = at != root
        at, of = at[going], of[going]
        if not len(at):
            break
        above = parent[at]
        owners.append(of)
        nodes.append(root - above)
        labels.append(~second[at])
        at = above
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(n + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    return np.concatenate(nodes)[order], np.concatenate(labels)[order].astype(np.float32), begins


def first_vectors(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Small random vectors that follow from the word's number and the seed."""
    with np.errstate(over="ignore"):
        x = (words[:, None] * size + np.arange(size)).astype(np.uint64)
        x = (x + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (((x >> np.uint64(40)).astype(np.float32) / 2**24) - 0.5) / size


def near_places(owner: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, ascending, and of the words at most their ``reach`` away in the sentence."""
    words, contexts, places = [], [], np.arange(len(owner))
    for far in range(1, min(WINDOW, len(owner) - 1) + 1):
        same = owner[:-far] == owner[far:]
        after, before = same & (reach[:-far] >= far), same & (reach[far:] >= far)
        words += [places[:-far][after], places[far:][before]]
        contexts += [places[far:][after], places[:-far][before]]
    if not words:
        return places[:0], places[:0]
    words, contexts = np.concatenate(words), np.concatenate(contexts)
    order = np.argsort(words, kind="stable")
    return words[order], contexts[order]


def _different(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids, and the place of each id among them; ``place`` is scratch space."""
    every = np.arange(len(ids))
    place[ids] = every
    different = ids[place[ids] == every]
    place[different] = every[: len(different)]
    return different, place[ids]


class Scratch:
    """Rows of numbers in a file without a name, in the order in which they were first put.

    It lies where Spark puts what its Python workers spill, and goes with the task.
    """

    def __init__(self, n: int) -> None:
        self.at, self.n, self.file = np.full(n, -1, np.int32), 0, None

    def take(self, rows: np.ndarray, taken: np.ndarray) -> None:
        """The rows into ``taken``, zeros for one that was never put."""
        for row, at in zip(taken, self.at[rows].tolist()):
            if at < 0:
                row[:] = 0.0
            else:
                os.preadv(self.file.fileno(), [row], at * row.nbytes)

    def put(self, rows: np.ndarray, values: np.ndarray) -> None:
        if self.file is None and len(rows):
            folders = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")
            self.file = tempfile.TemporaryFile(dir=folders[os.getpid() % len(folders)], buffering=0)
        new = rows[self.at[rows] < 0]
        self.at[new] = np.arange(self.n, self.n + len(new))
        self.n += len(new)
        for row, at in zip(values, self.at[rows].tolist()):
            if os.pwrite(self.file.fileno(), row, at * row.nbytes) < row.nbytes:
                raise OSError("no room for word vectors in the folder of the task")


class Trainer:
    """The vectors of one task: the first ``held`` words and nodes in memory, others in files."""

    def __init__(self, tree: tuple[np.ndarray, np.ndarray], size: int, seed: int, held: int | None = None) -> None:
        self.tree, self.size, self.seed = tree, size, seed
        self.n_words = (len(tree[0]) + 1) // 2
        held, n_nodes = HELD if held is None else held, max(self.n_words - 1, 1)
        self.known, self.met = np.zeros(self.n_words, bool), np.zeros(self.n_words, bool)
        # Pages that nothing is written to take no memory.
        self.inputs = np.zeros((min(self.n_words, held), size), np.float32)
        self.outputs = np.zeros((min(n_nodes, held), size), np.float32)
        self.rare_inputs = Scratch(self.n_words - len(self.inputs))
        self.rare_outputs = Scratch(n_nodes - len(self.outputs))

    def learn(self, ids: np.ndarray, owner: np.ndarray, reach: np.ndarray, rate: float) -> None:
        """Raise the likelihood of the words of some sentences after their contexts."""
        words, contexts = near_places(owner, reach)
        self.met[ids[contexts]] = True
        # What these sentences need is laid out by itself, and put back at the end.
        own, ids = np.unique(ids, return_inverse=True)
        inputs = _taken(self.inputs, self.rare_inputs, own)
        new = ~self.known[own]
        inputs[new] = first_vectors(own[new], self.size, self.seed)
        self.known[own] = True
        self.nodes, self.labels, self.begins = paths(*self.tree, own)
        nodes, at = np.unique(self.nodes, return_inverse=True)
        outputs = _taken(self.outputs, self.rare_outputs, nodes)
        vectors, place = (inputs, outputs, at), np.empty(max(len(own), len(nodes)), np.int64)
        cuts = np.searchsorted(words, np.arange(0, len(ids) + STEP, STEP)).tolist()
        for begin, i, j in zip(range(0, len(ids), STEP), cuts, cuts[1:]):
            if i < j:
                first = max(begin - WINDOW, 0)
                near = ids[first : begin + STEP + WINDOW]
                pairs = words[i:j] - begin, contexts[i:j] - first
                self._step(vectors, ids[begin : begin + STEP], near, pairs, rate, place)
        _put(self.inputs, self.rare_inputs, own, inputs)
        _put(self.outputs, self.rare_outputs, nodes, outputs)

    def vectors_of(self, words: np.ndarray) -> np.ndarray:
        """The vectors of words that were met, by ascending number."""
        return _taken(self.inputs, self.rare_inputs, words)

    def _step(
        self,
        vectors: tuple[np.ndarray, np.ndarray, np.ndarray],
        ids: np.ndarray,
        near: np.ndarray,
        pairs: tuple[np.ndarray, np.ndarray],
        rate: float,
        place: np.ndarray,
    ) -> None:
        """Some words of ``ids``, by place, each after a context of ``near``, in a few products.

        ``vectors`` are those of the words and nodes at hand, and the nodes of the paths among them.
        """
        of_words, of_nodes, on_path = vectors
        words, contexts = pairs
        own, of_word = _different(ids, place)
        near, of_context = _different(near, place)
        n = np.bincount(of_context[contexts] * len(own) + of_word[words], minlength=len(near) * len(own))
        n = n.reshape(len(near), len(own)).astype(np.float32)
        begins = self.begins[own]
        lengths = self.begins[own + 1] - begins
        ends = np.cumsum(lengths)
        flat = np.repeat(begins - ends + lengths, lengths) + np.arange(ends[-1])
        nodes, at = _different(on_path[flat], place)
        owner = np.repeat(np.arange(len(own)), lengths)
        passed, first = np.zeros((2, len(own), len(nodes)), np.float32)
        passed[owner, at] = 1.0
        first[owner, at] = self.labels[flat]
        inputs, outputs = of_words[near], of_nodes[nodes]
        passes = n @ passed
        # exp(-x) as it is up to 80, beyond which the share is zero in any case.
        off = n @ first - passes / (1.0 + np.exp(-np.maximum(inputs @ outputs.T, -80.0)))
        # Many pairs of one vector would overshoot together; by itself each takes a
        # shorter step than the one before. The slope changes by at most a quarter.
        bend = np.float32(rate / 2)
        steep_inputs = 1.0 + bend * (passes @ np.einsum("ij,ij->i", outputs, outputs))
        steep_outputs = 1.0 + bend * (np.einsum("ij,ij->i", inputs, inputs) @ passes)
        off *= np.float32(rate)
        of_words[near] = inputs + (off @ outputs) / steep_inputs[:, None]
        of_nodes[nodes] = outputs + (off.T @ inputs) / steep_outputs[:, None]


def _taken(held: np.ndarray, rare: Scratch, rows: np.ndarray) -> np.ndarray:
    """Rows by ascending number, the first of them held."""
    n = np.searchsorted(rows, len(held))
    taken = np.empty((len(rows), held.shape[1]), np.float32)
    np.take(held, rows[:n], axis=0, out=taken[:n], mode="clip")
    rare.take(rows[n:] - len(held), taken[n:])
    return taken


def _put(held: np.ndarray, rare: Scratch, rows: np.ndarray, values: np.ndarray) -> None:
    n = np.searchsorted(rows, len(held))
    held[rows[:n]] = values[:n]
    rare.put(rows[n:] - len(held), values[n:])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of words, some sentences at once, and the sentence of each."""
    held: list[np.ndarray] = []
    size = 0
    for batch in in_pieces(batches):
        for ids in batch.column(0).to_pylist():
            own = np.frombuffer(ids, "<i4")
            for begin in range(0, len(own), LONGEST):
                held.append(own[begin : begin + LONGEST])
                size += len(held[-1])
                if size >= TOKENS:
                    yield _laid_out(held)
                    held, size = [], 0
    if held:
        yield _laid_out(held)


def _laid_out(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate(held).astype(np.int64)
    return ids, np.repeat(np.arange(len(held)), [len(own) for own in held])


def _numbered(lemmas: DataFrame, words: Broadcast[pa.Array]) -> DataFrame:
    """``ids binary``: one int32 for each listed word of an article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = words.value
        # Every piece looks the list through once, so it is no shorter than the list.
        for batch in in_pieces(batches, max(AT_ONCE, listed.nbytes)):
            lists = batch.column(0)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(lists.flatten(), value_set=listed, skip_nulls=True), -1)
            at = at.to_numpy(zero_copy_only=False).astype("<i4")
            known = at >= 0
            kept = np.concatenate([[0], np.cumsum(known)])
            ends = 4 * kept[np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)]
            offsets = pa.array(ends.astype(np.int32)).buffers()[1]
            made = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(at[known].tobytes())])
            yield pa.RecordBatch.from_arrays([made], ["ids"])

    return lemmas.select("lemmas").mapInArrow(run, "ids binary")


def train(
    lemmas: DataFrame, terms: list[str] | None, size: int, seed: int, min_count: int, tasks: int
) -> DataFrame:
    """``word, vector array<float>``, staged, of words found ``min_count`` times or more.

    All of them are trained, as each learns from those beside it; with
    ``terms``, only the vectors of these are given. The texts are dealt to
    ``tasks`` tasks; a word's vector is the mean over the tasks that met it
    beside another word.
    """
    spark = lemmas.sparkSession
    counted = word_counts(lemmas).where(F.col("n") >= min_count).toArrow()
    counted = counted.sort_by([("n", "descending"), ("word", "ascending")])
    listed, wanted = counted.column("word").cast(pa.string()), None
    if terms is not None:
        wanted = np.flatnonzero(pc.is_in(listed, value_set=pa.array(terms, pa.string())))
    if not len(listed if wanted is None else wanted):
        raise ValueError(f"no word is found {min_count} times")
    counts, n_words = counted.column("n").to_numpy(), len(counted)
    shared, total = spark.sparkContext.broadcast(huffman(counts)), int(counts.sum()) + 1
    words = spark.sparkContext.broadcast(listed.combine_chunks())

    def given(block: int) -> np.ndarray:
        at = np.arange(block * BLOCK, min((block + 1) * BLOCK, n_words))
        return at if wanted is None else np.intersect1d(at, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        random = np.random.default_rng([seed, part])
        trainer, done = Trainer(shared.value, size, seed), 0
        for ids, owner in _sentences(batches):
            rate = max(RATE * (1 - tasks * done / total), LEAST_RATE)
            trainer.learn(ids, owner, random.integers(1, WINDOW + 1, len(ids)), rate)
            done += len(ids)
        # The larger file goes before vectors are sent.
        del trainer.outputs, trainer.rare_outputs
        for block in range(-(-n_words // BLOCK)):
            met = given(block)
            met = met[trainer.met[met]]
            if len(met):
                row = (block, part, met.astype("<i4").tobytes(), trainer.vectors_of(met).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

    names, kinds = ["block", "part", "met", "vectors"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    ids = _numbered(lemmas, words).repartition(tasks)
    parts = ids.mapInArrow(run, "block int, part int, met binary, vectors binary")

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")
        block = rows.column("block")[0].as_py()
        sums, n = np.zeros((BLOCK, size)), np.zeros(BLOCK)
        for met, vectors in zip(rows.column("met").to_pylist(), rows.column("vectors").to_pylist()):
            at = np.frombuffer(met, "<i4") - block * BLOCK
            sums[at] += np.frombuffer(vectors, "<f4").reshape(-1, size)
            n[at] += 1
        # A word that is never beside another keeps its first vector.
        at = given(block)
        sums, n = sums[at - block * BLOCK], n[at - block * BLOCK]
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], first_vectors(at, size, seed))
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * size)
        lists = pa.ListArray.from_arrays(offsets, pa.array(means.astype(np.float32).ravel()))
        return pa.table({"word_id": pa.array(at.astype(np.int32)), "vector": lists})

    # Every block is there once, whether or not a task met a word of it.
    every = spark.range(0, n_words, BLOCK).select(
        (F.col("id") / BLOCK).cast("int").alias("block"), F.lit(-1).alias("part"),
        F.lit(b"").alias("met"), F.lit(b"").alias("vectors"),
    )
    vectors = parts.unionByName(every).groupBy("block").applyInArrow(mean, "word_id int, vector array<float>")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([words.value.take(batch.column(0)), batch.column(1)], ["word", "vector"])

    return staged(vectors.mapInArrow(named, "word string, vector array<float>"), "word-vectors")
