"""Quality rules over whole texts, and a conditional random field that marks each line as content or boilerplate.

The rules count words, code points in words, symbols, repeated lines and words inside repeated windows of five words; a
text with few words or mostly repeated windows fails at once. For the others Viterbi decoding of a linear-chain conditional
random field labels the lines that hold a word (two labels, start and transition weights, ``FEATURES`` numbers of a line);
the text stays if content lines hold at least ``CONTENT_SHARE`` of its words.

The field is trained here, in numpy, by the forward-backward gradient on a bounded sample: at most ``TRAIN_DOCS`` labelled
texts of at most ``TRAIN_LINES`` lines, those whose id has the smallest hash, one row per id; ids whose crc32 mod 5 is 0 are
left out, so they can test it. Labels are per text: lines of good texts are content; those of bad texts are
boilerplate unless a fit of the lines alone takes them for content. Without texts of both kinds every line is content.

Windows are compared exactly, word by word, over a slice of texts at once; no text is cut. Null and empty texts have no words and
fail. Null and repeated ids and repeated rows keep their rows; extra columns are ignored; an empty table gives an empty
result. A share of exactly ``CONTENT_SHARE`` stays; two label paths of equal score give content."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import byte_slices

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent
CONTENT_SHARE = 0.5
TRAIN_DOCS = 2000
TRAIN_LINES = 400
ROUNDS = 200
SLICE_BYTES = 4 << 20
SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "words", "short", "symbols", "bars", "shouts", "capitals", "digits", "stops", "ends", "distinct", "seen", "long_words")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


SPACE = _table(b" \t\n\x0b\x0c\r")
CLASSES = {
    "symbols": _table(SYMBOLS), "bars": _table(b"|"), "shouts": _table(b"!?"), "capitals": _table(bytes(range(65, 91))),
    "digits": _table(b"0123456789"), "stops": _table(b".,;:"), "letters": _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))),
    "inner": _table(bytes(range(128, 192))),
}


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def repeated_words(codes: np.ndarray, text: np.ndarray, n_texts: int, window: int = WINDOW) -> np.ndarray:
    """Per text: words inside windows that occur twice or more in it. ``codes``: word numbers, ``text``: the text of each."""
    out = np.zeros(n_texts, np.int64)
    if len(codes) < window:
        return out
    names, span = codes.astype(np.int64), 1  # names of spans of 1, 2, 4, 8 words starting at each place
    parts, left, at = [], window, 0
    while left:
        if left & 1:
            parts.append((names, at))
            at += span
        left >>= 1
        if left:
            pair = names[: len(names) - span] * (int(names.max()) + 1) + names[span:]
            names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
            span *= 2
    n = len(codes) - window + 1
    key = text[:n].astype(np.int64)
    for names, at in parts:
        key = np.unique(key * (int(names.max()) + 1) + names[at : at + n], return_inverse=True)[1].astype(np.int64)
    inside = text[:n] == text[window - 1 :]
    again = inside & (np.bincount(key[inside], minlength=int(key.max()) + 1)[key] > 1)
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return np.bincount(text, np.cumsum(edge[:-1]) > 0, n_texts).astype(np.int64)


def _lines(texts: list[bytes]):
    """Per line with a word: its features; per text: base counts, and how many such lines it has."""
    known, codes, per, n_lines, dup = _Codes(), [], [], [], []
    kept, seen_before = [], []
    for t in texts:
        words = t.split()
        codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        per.append(len(words))
        seen, n = set(), 0
        for line in t.split(b"\n"):
            if line and not line.isspace():
                kept.append(line)
                seen_before.append(line in seen)
                seen.add(line)
                n += 1
        n_lines.append(n)
        dup.append(n - len(seen))
    per, n_lines = np.array(per, np.int64), np.array(n_lines, np.int64)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    repeated = repeated_words(flat, np.repeat(np.arange(len(texts)), per), len(texts))
    of_line = np.repeat(np.arange(len(texts)), n_lines)
    raw = np.frombuffer(b"\n".join(kept) + b"\n", np.uint8) if kept else np.zeros(0, np.uint8)
    ends = np.flatnonzero(raw == 10) if kept else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)) if kept else ends
    count = lambda flags: np.add.reduceat(flags, starts) if kept else np.zeros(0, np.int64)
    space = SPACE[raw]
    begins = ((space == 0) & (np.concatenate(([1], space[:-1])) == 1)).astype(np.int32)
    words = count(begins)
    got = {name: count(table[raw]) for name, table in CLASSES.items()}
    chars = count(1 - space) - got["inner"]
    first = np.cumsum(words) - words  # number of a line's first word among all words
    distinct = np.zeros(len(words))
    if len(flat):
        line_of = np.repeat(np.arange(len(words)), words)
        own = np.unique(line_of * len(known) + flat)
        distinct = np.bincount(own // len(known), minlength=len(words))
    last = raw[np.maximum(ends - 1, 0)] if kept else raw
    rate = lambda x: np.minimum(x / np.maximum(words, 1), 2.0)
    features = np.stack([
        np.ones(len(words)), np.log1p(words) / 4, words < 4, rate(got["symbols"]), rate(got["bars"]), rate(got["shouts"]),
        got["capitals"] / np.maximum(got["letters"], 1), got["digits"] / np.maximum(chars, 1), rate(got["stops"]), CLASSES["stops"][last] > 0,
        distinct / np.maximum(words, 1), np.array(seen_before, bool), np.minimum(chars / np.maximum(words, 1) / 20, 3.0),
    ], axis=1).astype(np.float64) if kept else np.zeros((0, len(FEATURES)))
    per_text = lambda x: np.bincount(of_line, x, len(texts)).astype(np.int64)
    base = {"n_words": per, "word_chars": per_text(chars), "n_symbols": per_text(got["symbols"]), "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeated}
    return features, words, n_lines, base


class Field:
    """Weights of the field: per label and feature, start and transition scores."""

    def __init__(self, emit: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.emit, self.start, self.move = emit, start, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.emit.T


def _places(lengths: np.ndarray):
    """Texts by falling number of lines; per step the row numbers of the lines that stand there."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")  # texts longer than the step
    return [first[:m] + t for t, m in enumerate(live.tolist())]


def viterbi(field: Field, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each line: 1 content, 0 boilerplate."""
    emit, labels = field.scores(features), np.zeros(len(features), np.int8)
    steps, back, best = _places(lengths), [], None
    for t, rows in enumerate(steps):
        if t == 0:
            best = emit[rows] + field.start
            continue
        paths = best[: len(rows), :, None] + field.move[None]
        came = np.where(paths[:, 1] >= paths[:, 0], 1, 0)
        now = np.take_along_axis(paths, came[:, None, :], 1)[:, 0] + emit[rows]
        back.append(came)
        best[: len(rows)] = now
    label = np.where(best[:, 1] >= best[:, 0], 1, 0) if steps else None
    for t in range(len(steps) - 1, -1, -1):
        rows = steps[t]
        labels[rows] = label[: len(rows)]
        if t:
            label[: len(rows)] = back[t - 1][np.arange(len(rows)), label[: len(rows)]]
    return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def likelihood(field: Field, features: np.ndarray, lengths: np.ndarray, labels: np.ndarray):
    """Log likelihood of the labels and its gradient (emit, start, move), by the forward-backward recursions."""
    emit, steps = field.scores(features), _places(lengths)
    forward = [emit[steps[0]] + field.start]
    for rows in steps[1:]:
        forward.append(_log_sum(forward[-1][: len(rows), :, None] + field.move[None], 1) + emit[rows])
    total = np.zeros(len(steps[0]))
    backward = [None] * len(steps)
    value, chance = 0.0, np.zeros_like(emit)
    g_move, g_start = np.zeros((2, 2)), np.zeros(2)
    for t in range(len(steps) - 1, -1, -1):
        rows = steps[t]
        b = np.zeros((len(rows), 2))
        if t + 1 < len(steps):
            nxt = steps[t + 1]
            b[: len(nxt)] = _log_sum(field.move[None] + (emit[nxt] + backward[t + 1])[:, None, :], 2)
        backward[t] = b
        ends_here = len(rows) if t + 1 == len(steps) else len(steps[t + 1])
        total[(0 if t + 1 == len(steps) else ends_here) : len(rows)] = _log_sum(forward[t], 1)[(0 if t + 1 == len(steps) else ends_here) :]
    for t, rows in enumerate(steps):
        chance[rows] = np.exp(forward[t] + backward[t] - total[: len(rows), None])
        if t:
            joint = np.exp(forward[t - 1][: len(rows), :, None] + field.move[None] + (emit[rows] + backward[t])[:, None, :] - total[: len(rows), None, None])
            was, now = labels[steps[t - 1][: len(rows)]], labels[rows]
            g_move += np.bincount(was * 2 + now, minlength=4).reshape(2, 2) - joint.sum(0)
            value += field.move[was, now].sum()
    at = labels[steps[0]]
    g_start += np.bincount(at, minlength=2) - chance[steps[0]].sum(0)
    value += emit[np.arange(len(emit)), labels].sum() + field.start[at].sum() - total.sum()
    hit = np.eye(2)[labels] - chance
    return value, (hit.T @ features, g_start, g_move)


def _climb(features, lengths, labels, chain: bool, rounds: int) -> Field:
    """Gradient ascent with step sizes per weight (Adam) on the mean likelihood with a small quadratic penalty."""
    shapes = [(2, features.shape[1]), (2,), (2, 2)]
    w = [np.zeros(s) for s in shapes]
    m, v = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    n = max(1, len(features))
    for i in range(1, rounds + 1):
        _, g = likelihood(Field(*w), features, lengths, labels)
        for j in range(3 if chain else 1):
            d = g[j] / n - 1e-4 * w[j]
            m[j], v[j] = 0.9 * m[j] + 0.1 * d, 0.99 * v[j] + 0.01 * d * d
            w[j] = w[j] + 0.2 * (m[j] / (1 - 0.9**i)) / (np.sqrt(v[j] / (1 - 0.99**i)) + 1e-8)
    return Field(*w)


def fit(features: np.ndarray, lengths: np.ndarray, good: np.ndarray, rounds: int = ROUNDS) -> Field:
    """From texts' lines and whether each text is good."""
    some = lengths > 0
    lengths, good = lengths[some], good[some]
    if not good.any() or good.all():
        return Field(np.zeros((2, features.shape[1])), np.zeros(2), np.zeros((2, 2)))
    of_line = np.repeat(good.astype(np.int64), lengths)
    alone = _climb(features, np.ones(len(features), np.int64), of_line, False, rounds)
    scores = alone.scores(features)
    labels = np.where((of_line == 0) & (scores[:, 0] > scores[:, 1]), 0, 1)
    return _climb(features, lengths, labels, True, rounds)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, most: int):
    key = F.col(id_col).cast("string")
    marks = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (F.crc32(key.cast("binary")) % 5 != 0))
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("_good"))
    marks = marks.orderBy(F.sha2(F.col("_id").cast("string"), 256)).limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "_id")

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                features, _, n, _ = _lines([(t or "").encode() for t in batch.column(1).to_pylist()])
                ends = np.cumsum(n)
                fine = np.flatnonzero(n <= TRAIN_LINES)
                data = [features[ends[i] - n[i] : ends[i]].astype("<f4").tobytes() for i in fine]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fine)), batch.column(2).take(pa.array(fine)), pa.array(data, pa.binary())], ["id", "good", "lines"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("_id", "text", "_good").mapInArrow(run, f"id {kind}, good int, lines binary")
    return found.groupBy("id").agg(F.min("good").alias("good"), F.min("lines").alias("lines")).orderBy("id").collect()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = TRAIN_DOCS) -> Field:
    rows = _sample(docs, labels, id_col, most)
    lines = [np.frombuffer(r["lines"], "<f4").reshape(-1, len(FEATURES)).astype(np.float64) for r in rows]
    good = np.array([bool(r["good"]) for r in rows], bool)
    return fit(np.concatenate(lines) if lines else np.zeros((0, len(FEATURES))), np.array([len(x) for x in lines], np.int64), good)


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words, kept) of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                features, words, n, base = _lines([(t or "").encode() for t in batch.column(1).to_pylist()])
                content = viterbi(field, features, n)
                held = np.bincount(np.repeat(np.arange(len(n)), n), words * content, len(n)).astype(np.int64)
                failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
                kept = ~failed & (held >= CONTENT_SHARE * base["n_words"])
                arrays = [pa.array(base[c]) for c in names] + [pa.array(failed), pa.array(held), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", *names, "base_failed", "content_words", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, {', '.join(c + ' long' for c in names)}, base_failed boolean, content_words long, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_content(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the verdict of every text, by a field trained on the labels."""
    return judge(docs, train(docs, labels, id_col), id_col)
