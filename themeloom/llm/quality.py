"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded by a small network;
gated attention gives each passage a weight, and the weighted mean of the
encodings is scored (Ilse et al., 2018). Labels stand on documents only; which
passages matter is learned.

Passage features come from the text alone: hashed byte pairs, and shares of
letters, capitals, digits, marks, white space and repeated words.

Only the model is fitted on a sample: at most ``SAMPLE`` labelled documents of
each label, those with the smallest hash of their doc_id, weighted back to the
labels' true shares, and of each at most ``MOST_PASSAGES`` passages, evenly
spaced. Everything else sees all rows and all passages.

Defined results: a null or empty text is one empty passage and gets a score;
labels that are null or other than 0 and 1 are not used; a doc_id with several
labels counts with each, and one with several texts is learned from one of
them, that with the smallest hash; without a label of each kind every score is the share
of label 1 (0.5 without labels); repeated rows are scored each; an empty table
gives an empty table.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from themeloom.llm.rows import map_batches
from themeloom.plans.staging import staged

WORDS = 64
HASHED = 256
MARKS = 10
FEATURES = HASHED + MARKS
HIDDEN = 24
GATE = 12
SAMPLE = 2000
MOST_PASSAGES = 400
EPOCHS = 24
BATCH = 64
RATE = 0.01
DECAY = 1e-4
SEED = 7
THRESHOLD = 0.7

# Hashes that agree beyond so many low bits are one of 4096 ranges.
HASH_SHIFT = 52
# Passages encoded at a time.
AT_ONCE = 4096


def passages(text: str | None, words: int = WORDS) -> list[list[str]]:
    tokens = (text or "").split()
    return [tokens[i : i + words] for i in range(0, len(tokens), words)] or [[]]


# Kinds of bytes: small letter, capital, digit, mark, beyond ASCII, space.
_KIND = np.full(256, 3, np.int64)
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[128:] = 4
_KIND[ord(" ")] = 5


def features(bag: list[list[str]]) -> np.ndarray:
    """One row of features per passage."""
    texts = [" ".join(tokens).encode() for tokens in bag]
    n = len(bag)
    lengths = np.array([len(t) for t in texts], np.int64)
    found = np.zeros((n, FEATURES), np.float32)
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    if len(data):
        of = np.repeat(np.arange(n), lengths)
        kinds = np.bincount(of * 6 + _KIND[data], minlength=n * 6).reshape(n, 6)
        pair = (data[:-1] * 31 + data[1:] * 131) % HASHED
        same = of[:-1] == of[1:]
        pairs = np.bincount((of[:-1] * HASHED + pair)[same], minlength=n * HASHED)
        share = np.maximum(lengths, 1)[:, None]
        found[:, :HASHED] = np.sqrt(pairs.reshape(n, HASHED) / share)
        found[:, HASHED : HASHED + 6] = kinds / share
    counts = np.array([len(tokens) for tokens in bag], np.float64)
    different = np.array([len(set(tokens)) for tokens in bag], np.float64)
    some = np.maximum(counts, 1)
    found[:, HASHED + 6] = different / some
    found[:, HASHED + 7] = np.log1p(counts)
    found[:, HASHED + 8] = lengths / some / 16
    found[:, HASHED + 9] = counts == 0
    return found


@dataclass
class Model:
    """Weights of the network; without weights every score is ``share``."""

    share: float
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoding and attention logit of each passage."""
        w = self.weights
        h = np.tanh((x - self.mean) / self.spread @ w["encode"] + w["encode_bias"])
        gate = np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))
        return h, gate @ w["attend"]

    def score(self, bag: list[list[str]]) -> tuple[float, int]:
        """Score of a document, and the passage with the largest weight.

        Long documents are encoded in parts; the softmax is carried along.
        """
        if self.weights is None:
            return self.share, 0
        top, total, sums, best = -np.inf, 0.0, np.zeros(HIDDEN), 0
        for begin in range(0, len(bag), AT_ONCE):
            h, logits = self.encode(features(bag[begin : begin + AT_ONCE]))
            at = int(logits.argmax())
            if logits[at] > top:
                shift = np.exp(top - logits[at])
                total, sums, top, best = total * shift, sums * shift, logits[at], begin + at
            a = np.exp(logits - top)
            total, sums = total + a.sum(), sums + a @ h
        logit = float(sums / total @ self.weights["score"] + self.weights["score_bias"][0])
        return float(1 / (1 + np.exp(-logit))), best


def train(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Fit by Adam on weighted log loss; ``bags`` has the features of each document."""
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(share)
    rng = np.random.default_rng(SEED)
    every = np.concatenate(bags)
    mean, spread = every.mean(axis=0), every.std(axis=0) + 0.02
    scaled = [(bag - mean) / spread for bag in bags]
    w = {
        "encode": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)),
        "encode_bias": np.zeros(HIDDEN),
        "tanh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "attend": rng.normal(0, GATE**-0.5, GATE),
        "score": rng.normal(0, HIDDEN**-0.5, HIDDEN),
        "score_bias": np.array([np.log(share / (1 - share))]),
    }
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    weights, step = weights / weights.mean(), 0
    for epoch in range(EPOCHS):
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(bags))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            sizes = np.array([len(scaled[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = np.repeat(np.arange(len(chosen)), sizes)
            x = np.concatenate([scaled[i] for i in chosen])
            h = np.tanh(x @ w["encode"] + w["encode_bias"])
            t = np.tanh(h @ w["tanh"])
            g = 1 / (1 + np.exp(-(h @ w["gate"])))
            e = (t * g) @ w["attend"]
            a = np.exp(e - np.maximum.reduceat(e, starts)[of])
            a /= np.add.reduceat(a, starts)[of]
            z = np.add.reduceat(a[:, None] * h, starts)
            p = 1 / (1 + np.exp(-(z @ w["score"] + w["score_bias"][0])))
            # Gradients, from the score back to the passages.
            d_logit = (p - labels[chosen]) * weights[chosen] / len(chosen)
            d_z = d_logit[:, None] * w["score"]
            d_h = a[:, None] * d_z[of]
            d_a = (h * d_z[of]).sum(axis=1)
            d_e = a * (d_a - np.add.reduceat(a * d_a, starts)[of])
            d_tg = d_e[:, None] * w["attend"]
            d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
            d_h += d_t @ w["tanh"].T + d_g @ w["gate"].T
            d_x = d_h * (1 - h * h)
            gradients = {
                "encode": x.T @ d_x,
                "encode_bias": d_x.sum(axis=0),
                "tanh": h.T @ d_t,
                "gate": h.T @ d_g,
                "attend": (t * g).T @ d_e,
                "score": z.T @ d_logit,
                "score_bias": np.array([d_logit.sum()]),
            }
            step += 1
            for k, grad in gradients.items():
                grad = grad + DECAY * w[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                rise = first[k] / (1 - 0.9**step)
                w[k] -= rate * rise / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(share, mean, spread, w)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo; null ids count as the text ``null``."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % modulus


def is_held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 4) == 2


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``label, share, text`` of at most ``sample`` documents of each label.

    ``share`` is the number of labelled rows of that label over those chosen.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.where(~is_held_out(F.col("doc_id")))
    usable = usable.select(
        F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("label")
    )
    hashed = usable.withColumn("_hash", F.xxhash64("_id"))
    # Ranges of the hash, counted, tell where the sample ends: only rows up to there are ranked.
    hashed = hashed.withColumn("_range", F.shiftright("_hash", HASH_SHIFT))
    counted = hashed.groupBy("label", "_range").agg(F.count(F.lit(1)).alias("rows"))
    of_label = W.partitionBy("label")
    before = F.sum("rows").over(of_label.orderBy("_range")) - F.col("rows")
    ends = counted.withColumn("before", before).withColumn("n", F.sum("rows").over(of_label))
    ends = ends.where(F.col("before") < sample)
    ends = ends.groupBy("label", "n").agg(F.max("_range").alias("last"))
    # One row for each of the two labels.
    near = hashed.join(F.broadcast(ends), "label").where(F.col("_range") <= F.col("last"))
    in_label = of_label.orderBy("_hash", "_id")
    chosen = near.withColumn("_rank", F.row_number().over(in_label)).where(
        F.col("_rank") <= sample
    )
    chosen = staged(chosen.select("_id", "label", "n"), "labelled-sample")
    # At most 2 x sample ids, so they can go to every executor.
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # One text for an id, however many rows have it; combined in the tasks first.
    one = F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).getField("text")
    return met.groupBy("label", "n", "_id").agg(one.alias("text"))


def spaced(bag: list[list[str]], most: int = MOST_PASSAGES) -> list[list[str]]:
    """At most so many of the passages, evenly spaced."""
    if len(bag) <= most:
        return bag
    return [bag[i * len(bag) // most] for i in range(most)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents that are not held out.

    Features are made in the tasks; those of the bounded sample are all that
    reaches the driver: 2 x SAMPLE x MOST_PASSAGES rows of FEATURES half-precision
    numbers at most, and a hundredth of it for texts of usual length.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            bags = [features(spaced(passages(text))) for text in batch.column(3).to_pylist()]
            return {
                "label": batch.column(0),
                "n": batch.column(1),
                "id": batch.column(2),
                "bag": pa.array([bag.astype("<f2").tobytes() for bag in bags], pa.binary()),
            }

        return work

    schema = "label int, n long, id long, bag binary"
    read = training_sample(docs, labels, sample).select(
        F.col("label").cast("int"), "n", "_id", "text"
    )
    rows = map_batches(read, schema, make).collect()
    rows.sort(key=lambda row: (row.id, row.label, len(row.bag), bytes(row.bag)))
    met = {label: sum(row.label == label for row in rows) for label in (0, 1)}
    bags = [np.frombuffer(row.bag, "<f2").reshape(-1, FEATURES).astype(np.float32) for row in rows]
    own = np.array([row.label for row in rows], np.float64)
    weights = np.array([row.n / met[row.label] for row in rows], np.float64)
    return train(bags, own, weights)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score, predicted, n_passages, top_passage``."""
    added = "score double, predicted int, n_passages long, top_passage long"
    fresh = [part.split()[0] for part in added.split(", ")]
    kept = docs.select(*[c for c in docs.columns if c not in fresh])
    names, at = kept.columns, kept.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            columns = {name: batch.column(i) for i, name in enumerate(names)}
            scores, sizes, tops = [], [], []
            for text in batch.column(at).to_pylist():
                bag = passages(text)
                score, top = fitted.score(bag)
                scores.append(score)
                sizes.append(len(bag))
                tops.append(top)
            columns["score"] = pa.array(scores, pa.float64())
            columns["predicted"] = pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())
            columns["n_passages"] = pa.array(sizes, pa.int64())
            columns["top_passage"] = pa.array(tops, pa.int64())
            return columns

        return work

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return map_batches(kept, f"{own}, {added}", make)


def op8_quality_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
