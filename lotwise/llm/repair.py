"""Token ids in grammar-compressed files.

Texts become ids (the library encodes each distinct word once while it is held in a worker's ``CACHE_BYTES``), documents
are dealt by ascending id, and runs of about ``SHARD_IDS`` ids become shards. A shard is compressed by Re-Pair: frequent pairs of neighbours are replaced by new
symbols, again and again; a round takes the ``PAIRS`` most frequent pairs at once, left to right where they overlap,
and the rounds end when no pair occurs ``LEAST`` times or after ``ROUNDS`` (how far to compress; any number decodes to
the same ids). Stored per shard, one row of the file: the rules, every rule's expansion length, the remaining sequence
with the position of each ``STRIDE``-th symbol, and the documents' ids and lengths. So a document, or any span, is
decoded without the rest of its shard.

Null and empty texts hold the end id alone. Repeated document ids keep one entry per row; null ids come first. Rows of one
id, or of none, are dealt by a row number as well, so however many they are no task must take them all. Extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.shared import byte_slices, fresh_path, gather, numbers, pack, planes, unpack, worker_state, written

END_ID = 2
SHARD_IDS = 1 << 21
ROUNDS = 8
PAIRS = 512
LEAST = 8
STRIDE = 256
SLICE_BYTES = 8 << 20
CACHE_BYTES = 24 << 20  # a slice is looked up in all of it, so a larger one costs more than it saves
AT_ONCE = 64  # texts that the library encodes in one call
TOGETHER = 128  # short words that make one such text
SHORT = 64  # bytes
MARKS = ".,;:!?"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the pattern that the cuts at words and marks are right for


class WordIds:
    """Ids of texts without spaces, as the tokenizers library gives them.

    A file that normalises by NFC, replacing and lower-casing and then takes words by a pattern keeps nothing across a
    space or line end, so texts are cut there and each distinct word is encoded once while it is held; with a file of another
    build texts stay whole. A mark of ``MARKS`` that ends a word behind a letter is a piece of its own in that pattern, so it is
    cut off. Words of letters of ASCII and Latin-1 alone are equal but for case, composed already and one piece each: they go
    to the file's model without its normaliser and pattern. Short words go to the library many at a time, parted by
    spaces: a token stands for a known number of bytes, so the ids fall apart at the words' lengths. Where they don't, the
    words are encoded one by one."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        try:
            steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
            cut, level = spec["pre_tokenizer"]["pretokenizers"]
            shape = (cut["behavior"], cut["invert"], level["type"], level["add_prefix_space"], level["use_regex"])
            self.cuts = steps == ["NFC", "Replace", "Lowercase"] and cut["pattern"]["Regex"] == PATTERN and shape == ("Removed", True, "ByteLevel", False, False)
        except (KeyError, TypeError, ValueError):
            self.cuts = False
        if self.cuts:
            by_space = {"type": "Sequence", "pretokenizers": [{"type": "CharDelimiterSplit", "delimiter": " "}, level]}
            self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": by_space, "added_tokens": []}))
        named = [*spec["model"]["vocab"].items(), *((t["content"], t["id"]) for t in spec.get("added_tokens") or [])]
        top = max(i for _, i in named)
        self.kind = np.uint32 if top >= 1 << 16 else np.uint16
        self.n_bytes = np.ones(top + 1, np.int64)  # one character of a byte-level token is one byte
        end = spec["model"].get("end_of_word_suffix") or ""
        for token, i in named:
            self.n_bytes[i] = max(1, len(token) - len(end) * token.endswith(end))
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.counts = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(0, np.int64)

    def of(self, words: list[str]) -> list[bytes]:
        """Of each word the ids, little-endian."""
        ids, counts = self.coded(pa.array(words, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(counts)[:-1])]

    def coded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one word after the other, and how many each has."""
        if self.words.nbytes + self.ids.nbytes + self.counts.nbytes > CACHE_BYTES:
            self.clear()
        if not self.cuts:
            return self.held(words)
        n = len(words)
        cores, mark = _parted(words)
        parts = pa.concat_arrays([cores, pa.array([*MARKS, ""])]).dictionary_encode()
        ids, counts = self.held(parts.dictionary)
        code = np.asarray(parts.indices).astype(np.int64)
        picks = np.stack([code[:n], code[n + mark]], 1).ravel()
        return gather(ids, np.cumsum(counts) - counts, counts, picks), counts[picks].reshape(-1, 2).sum(1)

    def held(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1)).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            order, ids, counts = self.encoded(words.take(pa.array(new)))
            at[new[order]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new[order]))])
            self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        return gather(self.ids, np.cumsum(self.counts) - self.counts, self.counts, at), self.counts[at]

    def encoded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' order, and in this order their ids and how many each has."""
        letter, simple, starts, ends = _kinds(words)
        size = ends - starts
        short = (size > 0) & (size <= SHORT) & self.cuts
        plain = short & (_inside(letter, starts, ends) == size)
        even = short & ~plain & (_inside(simple, starts, ends) == size)
        done = [self.together(self.plain, words, np.flatnonzero(plain), size)] if plain.any() else []
        if even.any():
            done.append(self.together(self.library, words, np.flatnonzero(even), size))
        rest = np.flatnonzero(~plain & ~even)
        if len(rest):
            done.append(self.others(words.take(pa.array(rest)).to_pylist(), rest))
        return tuple(np.concatenate(x) for x in zip(*done))

    def together(self, library, words: pa.StringArray, at: np.ndarray, size: np.ndarray):
        """Words that normalising leaves at their ``size`` in bytes."""
        cuts = pa.array(np.append(np.arange(0, len(at), TOGETHER), len(at)), pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, words.take(pa.array(at))), " ").to_pylist()
        ids = np.concatenate(list(self.given(library, texts)))
        counts = self.apart(ids, size[at])
        return self.others(words.take(pa.array(at)).to_pylist(), at) if counts is None else (at, ids, counts)

    def others(self, words: list[str], at: np.ndarray):
        ids, counts = [np.zeros(0, self.kind)] * len(words), [None] * len(words)
        short = [i for i, w in enumerate(words) if self.cuts and len(w) <= SHORT and w.split() == [w]]
        groups = [short[k : k + TOGETHER] for k in range(0, len(short), TOGETHER)]
        for group, found in zip(groups, self.given(self.library, [" ".join([words[i] for i in g]) for g in groups])):
            stops = self.stops([words[i] for i in group], found)
            if stops is not None:
                for i, part in zip(group, np.split(found, stops[:-1])):
                    ids[i], counts[i] = part, len(part)
        alone = [i for i, n in enumerate(counts) if n is None]
        for i, found in zip(alone, self.given(self.library, [words[i] for i in alone])):
            ids[i], counts[i] = found, len(found)
        return at, np.concatenate(ids), np.array(counts, np.int64)

    def given(self, library, texts: list[str]):
        for at in range(0, len(texts), AT_ONCE):
            for e in library.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False):
                yield np.array(e.ids, self.kind)

    def stops(self, words: list[str], ids: np.ndarray) -> list[int] | None:
        """Number of ids up to the end of each word, or None where they don't fall apart at the words."""
        form = self.library.normalizer.normalize_str
        counts = self.apart(ids, np.array([len(w if w.isascii() else form(w).encode()) for w in words]))
        return None if counts is None else np.cumsum(counts).tolist()

    def apart(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray | None:
        """Number of ids of each word, or None where the bytes of the ids are not those of the words."""
        ends, held = np.cumsum(sizes), np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(held, ends)
        if not len(held) or held[-1] != ends[-1] or (held[at] != ends).any():
            return None
        return np.diff(at, prepend=-1)


def _kinds(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per byte: is it of a letter of ASCII or Latin-1, and is it of one or of visible ASCII; where each word starts and ends."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    byte = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    before = np.concatenate(([np.uint8(0)], byte[:-1])) if len(byte) else byte
    second = (before == 0xC3) & (byte != 0x97) & (byte != 0xB7)  # not the signs for times and divided by
    latin = second.copy()
    latin[:-1] |= second[1:]
    letter = latin | ((byte | 32) - np.uint8(97) < 26)
    return letter, letter | ((byte > 32) & (byte < 127)), ends[:-1], ends[1:]


def _inside(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[ends] - total[starts]


def _parted(words: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Words without the mark at their end, lower-cased if they are all letters, and the mark's place in ``MARKS`` (or their number)."""
    letter, _, starts, ends = _kinds(words)
    mark = np.full(len(words), len(MARKS), np.int64)
    long = np.flatnonzero(ends - starts > 1)
    if len(long):
        byte = np.frombuffer(words.buffers()[2], np.uint8)[np.frombuffer(words.buffers()[1], np.int32)[words.offset] :]
        place = np.full(256, len(MARKS), np.int64)
        place[list(MARKS.encode())] = np.arange(len(MARKS))
        mark[long] = np.where(letter[ends[long] - 2], place[byte[ends[long] - 1]], len(MARKS))
    cut = mark < len(MARKS)
    cores = pc.if_else(pa.array(cut), pc.utf8_rtrim(words, characters=MARKS), words)
    own = _inside(letter, starts, ends) == ends - starts - cut
    return pc.if_else(pa.array(own), pc.utf8_lower(cores), cores), mark


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, n, ids): ids of the whole text and the end id, as little-endian integers of ids' length / n bytes."""

    def run(batches):
        known = worker_state("ids:" + path, lambda: WordIds(path))
        width, end = np.dtype(known.kind).itemsize, np.array([end_id], known.kind).tobytes()
        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                text = pc.fill_null(batch.column(1), "")
                if known.cuts:
                    words = pc.split_pattern(pc.replace_substring(text, "\n", " "), " ")
                    per, flat = np.asarray(pc.list_value_length(words)).astype(np.int64), words.flatten().dictionary_encode()
                else:
                    per, flat = np.ones(len(text), np.int64), text.dictionary_encode()
                ids, counts = known.coded(flat.dictionary)
                codes = np.asarray(flat.indices).astype(np.int64)
                raw = gather(ids, np.cumsum(counts) - counts, counts, codes).tobytes()
                cuts = np.concatenate(([0], np.cumsum(counts[codes])))[np.concatenate(([0], np.cumsum(per)))] * width
                rows = [raw[a:b] + end for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) // width for r in rows], pa.int64()), pa.array(rows, pa.binary())], ["id", "n", "ids"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, n long, ids binary")


def compress(ids: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST):
    """(first new symbol, left, right, sequence): rule i says that symbol first + i stands for left[i], right[i]."""
    seq = ids.astype(np.uint32)
    first = int(seq.max()) + 1 if len(seq) else 1
    left, right, symbol = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], first
    for _ in range(rounds):
        if len(seq) < 2:
            break
        a, b = seq[:-1], seq[1:]
        cell = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)
        held = np.bincount(cell, minlength=1 << 18)
        bound = max(least, int(np.partition(held, -pairs)[-pairs]))  # a pair is no more frequent than its cell
        full = np.flatnonzero(held >= bound)
        if not len(full):
            break
        number = np.full(1 << 18, -1, np.int32)
        number[full] = np.arange(len(full))
        own = number[cell]
        at = np.flatnonzero(own >= 0)
        own = own[at]
        # a cell proposes a pair that it holds, which is most likely its most frequent one; its count is exact
        some = np.empty(len(full), np.int64)
        some[own[len(own) // 2 :]] = at[len(own) // 2 :]
        some[own[: len(own) // 2]] = at[: len(own) // 2]
        la, lb = a[some], b[some]
        same = (a[at] == la[own]) & (b[at] == lb[own])
        at, own = at[same], own[same]
        count = np.bincount(own, minlength=len(full))
        chosen = np.flatnonzero(count >= least)
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-count[chosen], kind="stable")][:pairs]
        name = np.full(len(full), -1, np.int64)
        name[chosen] = symbol + np.arange(len(chosen))
        new = name[own]
        at, new = at[new >= 0], new[new >= 0]
        n = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, n, 0))
        take = (n - run) % 2 == 0
        left.append(la[chosen].astype(np.int64))
        right.append(lb[chosen].astype(np.int64))
        seq[at[take]] = new[take]
        keep = np.ones(len(seq), bool)
        keep[at[take] + 1] = False
        seq = seq[keep]
        symbol += len(chosen)
    seq = seq.astype(np.int64)
    return first, np.concatenate(left), np.concatenate(right), seq


class Shard:
    """A stored shard: whole or partial decoding."""

    def __init__(self, value: bytes):
        head, left, right, lengths, seq, marks, docs, missing, counts = unpack(value)
        self.first = int(np.frombuffer(head, np.int64)[0])
        self.left, self.right, self.lengths, self.seq = numbers(left), numbers(right), numbers(lengths), numbers(seq)
        self.marks = np.frombuffer(marks, np.int64)
        self.docs, self.missing, self.counts = np.frombuffer(docs, np.int64), np.frombuffer(missing, bool), numbers(counts).astype(np.int64)
        terms: list[np.ndarray] = []
        for a, b in zip(self.left.tolist(), self.right.tolist()):
            parts = [terms[s - self.first] if s >= self.first else np.array([s], np.uint32) for s in (a, b)]
            terms.append(np.concatenate(parts))
        self.terms = terms

    def expand(self, seq: np.ndarray) -> np.ndarray:
        used, codes = np.unique(seq, return_inverse=True)
        parts = [self.terms[s - self.first] if s >= self.first else np.array([s], np.uint32) for s in used.tolist()]
        n = np.array([len(p) for p in parts], np.int64)
        return gather(np.concatenate(parts), np.cumsum(n) - n, n, codes) if parts else np.zeros(0, np.uint32)

    def ids(self) -> np.ndarray:
        return self.expand(self.seq)

    def span(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the shard; only the symbols around them are expanded."""
        mark = int(np.searchsorted(self.marks, start, "right")) - 1
        stop = int(np.searchsorted(self.marks, start + n, "left"))
        part = self.expand(self.seq[mark * STRIDE : stop * STRIDE])
        return part[start - int(self.marks[mark]) :][:n]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.counts[:i].sum()), int(self.counts[i]))


def store(ids: np.ndarray, docs: np.ndarray, missing: np.ndarray, counts: np.ndarray) -> bytes:
    first, left, right, seq = compress(ids)
    lengths = np.ones(len(left), np.int64)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        lengths[i] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    sizes = np.where(seq >= first, lengths[np.maximum(seq - first, 0)] if len(lengths) else 1, 1)
    marks = (np.cumsum(sizes) - sizes)[::STRIDE]
    return pack(np.array([first], np.int64), planes(left), planes(right), planes(lengths), planes(seq), marks.astype(np.int64), docs, missing, planes(counts))


FILE = "first_doc long, first_row long, n_ids long, shard binary"


def write_files(tokens: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Tokens to compressed shards in ascending id order."""

    def run(batches):
        held, n = [], 0

        def flush():
            docs = np.array([0 if d is None else d for d, _, _, _ in held], np.int64)
            missing = np.array([d is None for d, _, _, _ in held], bool)
            counts = np.array([c for _, _, c, _ in held], np.int64)
            ids = np.concatenate([np.frombuffer(v, np.uint16 if len(v) == 2 * c else np.uint32) for _, _, c, v in held])
            row = ([held[0][0]], [held[0][1]], [n], [store(ids, docs, missing, counts)])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["first_doc", "first_row", "n_ids", "shard"])

        for batch in batches:
            for d, r, c, v in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if held and n + c > shard_ids:
                    yield flush()
                    held, n = [], 0
                held.append((d, r, c, v.as_py()))
                n += c
        if held:
            yield flush()

    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.select("id", F.monotonically_increasing_id().alias("row"), "n", "ids").repartitionByRange(parts, "id", "row").sortWithinPartitions("id", "row")
    rows.mapInArrow(run, FILE).write.option("compression", "none").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone."""

    def run(batches):
        for batch in batches:
            for begin, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(value.as_py())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(shard.counts)
                starts = ends - shard.counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.docs, mask=shard.missing), pa.array(begin + starts), pa.array(shard.counts), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE).parquet(path)
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "first_row").rowsBetween(Window.unboundedPreceding, -1)
    begins = files.select("first_row", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("begin"))  # one line per shard
    return files.join(begins, "first_row").select("begin", "shard").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts to files in the shared folder and back."""
    spark = docs.sparkSession
    out = fresh_path(spark, "ids")
    write_files(written(tokenize(docs, path, id_col, text_col), "tokens"), out)
    return read_files(spark, out).withColumnRenamed("id", id_col)
