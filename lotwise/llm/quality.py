"""A quality classifier: supervised subword embeddings, averaged per document, with a softmax over two classes.

Features of a document are its words, the characters in twos and threes of every word between brackets, and pairs of
neighbouring words that are equal (one feature for all); each is hashed to one of ``BUCKETS`` learned vectors. The
document's vector is the mean over all features of its whole text; a linear layer and a softmax give the score. The
model is trained by stochastic gradient descent in numpy on a bounded sample: at most ``TRAIN_ROWS`` labelled documents,
those whose id has the smallest hash. Classes weigh alike in training. Documents whose crc32(id) mod 5 is 0 are held out.

Scoring is linear in the text: every distinct word's part of the sum is worked out once per batch. Null and empty texts
have no features, so their score is that of the layer's bias. Labels, language, source and id are no features. Rows
are kept as they are. Without a labelled row to learn from the model is even-handed: every score is 0.5."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import byte_slices

BUCKETS = 1 << 16
DIMS = 12
TRAIN_ROWS = 6000
EPOCHS = 6
RATE = 0.5
ACCEPT = 0.3
SCALE = 100.0
SLICE_BYTES = 4 << 20
AGAIN = 0  # the bucket of "the same word again"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of the words: the word, its bytes in twos and in threes."""
    lines = [b"<" + w + b">" for w in words]
    sizes = np.array([len(x) for x in lines], np.int64)
    text = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(lines)), sizes)
    whole = np.fromiter((zlib.crc32(x) for x in lines), np.uint64, len(lines)) & np.uint64(0xFFFF)
    numbers, buckets = [np.arange(len(lines))], [whole]
    gram = text
    for n in (2, 3):
        gram = (gram[:-1] << np.uint64(8)) | text[n - 1 :]
        inside = of[: len(gram)] == of[n - 1 :]
        mixed = (gram[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        numbers.append(of[: len(gram)][inside])
        buckets.append(mixed >> np.uint64(48))
    return np.concatenate(numbers), np.concatenate(buckets).astype(np.int64)


def _words(batch: pa.RecordBatch, column: int):
    """Distinct words of the texts, their numbers by position, words per text."""
    text = pc.fill_null(batch.column(column), "")
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    flat = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return words, np.asarray(flat.indices).astype(np.int64), _per_text(lists)


def _per_text(lists) -> np.ndarray:
    """Words per text; leading and trailing white space leaves empty ones, which do not count."""
    n = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    full = np.asarray(pc.not_equal(lists.flatten(), ""))
    return np.bincount(np.repeat(np.arange(len(n)), n), full, len(n)).astype(np.int64)


def _repeats(codes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    if len(codes) < 2:
        return np.zeros(n, np.int64)
    same = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    return np.bincount(rows[1:][same], minlength=n)


def document_features(rows: DataFrame) -> DataFrame:
    """(label, buckets, counts) of rows (label, text)."""

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                words, codes, per = _words(batch, 1)
                at_word, buckets = word_features(list(words))
                buckets = buckets[np.argsort(at_word, kind="stable")]
                of_word = np.split(buckets, np.cumsum(np.bincount(at_word, minlength=len(words)))[:-1])
                ends, out = np.cumsum(per), []
                for s, e in zip((ends - per).tolist(), ends.tolist()):
                    own, n = np.unique(codes[s:e], return_counts=True)
                    lists = [of_word[w] for w in own]
                    full = np.concatenate([*lists, [AGAIN]]) if e > s else np.zeros(0, np.int64)
                    again = int((codes[s + 1 : e] == codes[s : e - 1]).sum()) if e > s else 0
                    weight = np.concatenate((np.repeat(n, [len(x) for x in lists]), [again])) if e > s else np.zeros(0, np.int64)
                    ids, at = np.unique(full, return_inverse=True)
                    out.append((ids.astype(np.uint16).tobytes(), np.bincount(at, weight, len(ids)).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["label", "buckets", "counts"])

    return rows.mapInArrow(run, "label int, buckets binary, counts binary")


class Model:
    """What scoring needs: each bucket's part of the difference between the two classes' outputs, and their bias."""

    def __init__(self, parts: np.ndarray, bias: float):
        self.parts, self.bias = parts, bias

    def score(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = np.where(counts > 0, sums / np.maximum(counts, 1), 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent over (label, buckets, counts), one document at a time, with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out, bias = np.zeros((2, DIMS), np.float32), np.zeros(2, np.float32)
    labels = np.array([s[0] for s in samples])
    weight = [len(labels) / (2 * max(1, int((labels == c).sum()))) for c in (0, 1)]
    steps, step = max(1, epochs * len(samples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, ids, counts = samples[i]
            pace = rate * (1 - step / steps)
            step += 1
            share = counts / counts.sum() if len(counts) else counts
            own = vectors[ids]
            mean = share @ own if len(ids) else np.zeros(DIMS, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[y] -= 1
            error *= min(weight[y], 10.0)
            back = error @ out
            out -= pace * np.outer(error, mean)
            bias -= 0.1 * pace * error
            if len(ids):  # the step is scaled so that a document's mean moves alike whether its features are many or few
                vectors[ids] = own - pace * min(float(1 / (share @ share)), SCALE) * share[:, None] * back
    return Model(vectors @ (out[1] - out[0]), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Model:
    """From documents with a 0 / 1 label that are not held out, at most ``most`` of them: of rows that share an id that
    with the smallest text digest."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(31)), "doc_id").limit(most)  # at most ``most`` ids
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.md5(F.coalesce("text", F.lit("")))).alias("text")).select("label", "text")  # one row per id
    got = document_features(texts).collect()
    samples = [(r["label"], np.frombuffer(r["buckets"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.float32)) for r in got]
    samples = [s for s in sorted(samples, key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes())) if len(s[1])]
    if not samples:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return fit(samples)


def scores(batch: pa.RecordBatch, column: int, model: Model) -> np.ndarray:
    words, codes, per = _words(batch, column)
    rows = np.repeat(np.arange(len(per)), per)
    at_word, buckets = word_features(list(words))
    sums, n = np.bincount(at_word, model.parts[buckets], len(words)), np.bincount(at_word, minlength=len(words))
    again = _repeats(codes, rows, len(per))
    total = np.bincount(rows, sums[codes], len(per)) + again * model.parts[AGAIN]
    return model.score(total, np.bincount(rows, n[codes], len(per)) + again)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    parts, bias = model.parts, model.bias

    def run(batches):
        m = Model(parts, bias)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch, 1, m))], ["id", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Documents that the classifier accepts; all columns. Each is decided where it is read, without a shuffle."""
    model = train(docs, labels)
    parts, bias, at = model.parts, model.bias, docs.columns.index("text")

    def run(batches):
        m = Model(parts, bias)
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                yield batch.filter(pa.array(scores(batch, at, m) >= accept))
                pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
