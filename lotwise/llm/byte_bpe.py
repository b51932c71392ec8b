"""Byte-level BPE over a corpus: every distinct word is encoded once for all documents, and its ids are joined back.

1. Texts are split into words with their positions (a word is a space and what follows it; it is split further by the
   vocabulary's pattern when it is encoded). Cutting before a space between two non-spaces never cuts a match of the
   pattern; texts with other runs of white space are cut at white space only, so which characters are letters is left to
   the library alone. A block of texts (``BLOCK_BYTES``)
   packs its distinct words by a hash into ``buckets`` rows and its positions into one row, in which a word's first
   occurrence is a zero.
2. The words are shuffled by bucket, so all occurrences of a word meet; each distinct word is encoded once.
3. The ids return to their block and are put in place of the positions.

Packed rows are compressed, so the shuffles carry less than the input. A hot word is one entry per block, whatever its
count. Decoding takes the bytes of every id from the vocabulary's table (one fixed table of the vocabulary's size).

Null and empty texts have no ids and decode to nothing. Rows are kept as they are, repeated ones too; extra columns are
ignored; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.shared import byte_slices, gather, numbers, pack, planes, unpack, worker_state

BLOCK_BYTES = 12 << 20
WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
AT_WHITE = re.compile(f" ?[^{_W}]+|[{_W}]+(?![^{_W}])|[{_W}]")  # pieces that no match of the pattern crosses
MARK = "\x1e"  # stands before each space while words are split; texts that contain it go the slow way
CACHED = 2_000_000
MAY_BE_WHITE = re.compile(rb"[\xc2\xe1\xe2\xe3]").search  # lead bytes of white space beyond ASCII


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str, pattern: str):
    import tiktoken

    return worker_state(f"bpe:{path}:{pattern}", lambda: tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}))


class TokenBytes:
    """The vocabulary's bytes by id, end to end."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.fill(by_id)

    def fill(self, pieces: list[bytes]):
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def like(self, pieces: list[bytes]) -> TokenBytes:
        other = TokenBytes.__new__(TokenBytes)
        other.fill(pieces)
        return other

    def of(self, ids: np.ndarray) -> bytes:
        return gather(self.blob, self.starts, self.lengths, ids).tobytes()


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words as bytes, word number by position, words per text)."""
    slow = np.asarray(pc.match_substring_regex(text, f"{WHITE}{WHITE}|{MARK}"))
    if slow.any():
        lists = [AT_WHITE.findall(t.as_py()) if s else None for t, s in zip(text, slow)]
        quick = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(slow), "", text), " ", MARK + " "), MARK)
        lists = [own if own is not None else rest for own, rest in zip(lists, quick.to_pylist())]
        words = pa.array(lists, pa.list_(pa.string()))
    else:
        words = pc.split_pattern(pc.replace_substring(text, " ", MARK + " "), MARK)
    flat = words.flatten().dictionary_encode()
    return flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), np.asarray(flat.indices).astype(np.int64), np.asarray(pc.list_value_length(words)).astype(np.int64)


def _encode_words(words: list[bytes], enc, lengths: np.ndarray) -> list[np.ndarray]:
    """Ids of every word. Words that begin with a space before a non-space are encoded end to end in one go, as the
    pattern always cuts between them, and parted again by their bytes; others go one by one."""
    out: list = [None] * len(words)
    plain = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == 32 and w[1] > 32 and w[-1] > 32 and not MAY_BE_WHITE(w)]
    rest = set(range(len(words))).difference(plain)
    if plain:
        ids = np.array(enc.encode_ordinary(b"".join([words[i] for i in plain]).decode()), np.uint32)
        ends = np.cumsum(lengths[ids])
        cuts = np.searchsorted(ends, np.cumsum([len(words[i]) for i in plain]), "left") + 1
        for i, part in zip(plain, np.split(ids, cuts[:-1])):
            out[i] = part
    for i in rest:
        out[i] = np.array(enc.encode_ordinary(words[i].decode()), np.uint32)
    return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers of the whole text."""
    buckets = buckets or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def explode(batches):
        for whole in batches:
            for batch in byte_slices(whole, "text", BLOCK_BYTES):
                text = pc.fill_null(batch.column(1), "")
                words, places, counts = _split(text)  # words are numbered as they first occur
                bucket = (np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets)
                first = np.ones(len(places), bool)
                first[1:] = places[1:] > np.maximum.accumulate(places)[:-1]
                ids = np.asarray(pc.fill_null(batch.column(0), 0)).astype(np.int64)
                missing = np.asarray(batch.column(0).is_null())
                head = [ids.tobytes(), missing.tobytes(), counts.astype(np.uint32).tobytes(), planes(np.where(first, 0, places + 1)), planes(bucket)]
                # the same rows give the same number, should a lost block be made again
                block = int.from_bytes(hashlib.blake2b(b"".join([*head, *words]), digest_size=8).digest()) >> 1
                rows = [(block, block, -1, pack(*head))]
                for b in np.unique(bucket).tolist():
                    own = words[bucket == b]
                    rows.append((b, block, b, pack(planes(np.array([len(w) for w in own])), b"".join(own))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["key", "block", "bucket", "packed"])
                del text, words, places, first, head, rows
                pa.default_memory_pool().release_unused()

    def encode_once(batches):
        enc = encoder(ranks_path, pattern)
        table = worker_state("bytes:" + ranks_path, lambda: TokenBytes(ranks_path))
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for i, (block, b, packed) in enumerate(zip(batch.column(0), batch.column(1), batch.column(2))):
                if b.as_py() < 0:
                    yield batch.slice(i, 1)
                    continue
                lengths, blob = unpack(packed.as_py())
                ends = np.cumsum(numbers(lengths), dtype=np.int64).tolist()
                blob = bytes(blob)
                words = [blob[s:e] for s, e in zip([0, *ends], ends)]
                fresh = [w for w in words if w not in known]
                if fresh:
                    if len(known) > CACHED:
                        known = {}
                        fresh = words
                    for w, ids in zip(fresh, _encode_words(fresh, enc, table.lengths)):
                        known[w] = ids.tobytes()
                found = [known[w] for w in words]
                counts = np.array([len(x) for x in found], np.uint32) // 4
                out = pack(planes(counts), planes(np.frombuffer(b"".join(found), np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([b.as_py()], pa.int32()), pa.array([out], pa.binary())], ["block", "bucket", "packed"])

    def assemble(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("bucket").to_pylist(), table.column("packed").to_pylist()))
        copies = sum(b < 0 for b, _ in rows)  # blocks of the same rows have the same number
        by_bucket = dict(rows)
        doc_ids, missing, per_text, packed, bucket = unpack(by_bucket.pop(-1))
        parts = [unpack(by_bucket[b]) for b in sorted(by_bucket)]
        counts = np.concatenate([numbers(c) for c, _ in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([numbers(x) for _, x in parts]) if parts else np.zeros(0, np.uint32)
        starts = np.cumsum(counts) - counts
        order = np.argsort(numbers(bucket).astype(np.uint16), kind="stable")  # place of the parts' words by number
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts, counts = starts[back], counts[back]
        places = numbers(packed).astype(np.int64) - 1
        new = places < 0
        places[new] = np.arange(int(new.sum()))
        per_text = np.frombuffer(per_text, np.uint32).astype(np.int64)
        raw = gather(ids, starts, counts, places).astype("<u4").tobytes()
        word_ends = np.concatenate(([0], np.cumsum(counts[places])))
        text_ends = word_ends[np.concatenate(([0], np.cumsum(per_text)))]
        values = pa.Array.from_buffers(pa.large_binary(), len(per_text), [None, pa.py_buffer((text_ends * 4).tobytes()), pa.py_buffer(raw)])
        keys = pa.array(np.frombuffer(doc_ids, np.int64), mask=np.frombuffer(missing, bool))
        made = pa.table([keys, pa.array(np.diff(text_ends)), values.cast(pa.binary())], ["id", "n_tokens", "ids"])
        pa.default_memory_pool().release_unused()
        return pa.concat_tables([made] * copies)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "block long, bucket int, packed binary"
    # words lie by bucket, positions by block; the latter pass through
    exploded = texts.mapInArrow(explode, "key long, " + schema).repartition(buckets, "key").select("block", "bucket", "packed")
    both = exploded.mapInArrow(encode_once, schema)
    out = both.groupBy("block").applyInArrow(assemble, "id long, n_tokens long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for, from the vocabulary's table of token bytes."""

    def run(batches):
        table = worker_state("bytes:" + ranks_path, lambda: TokenBytes(ranks_path))
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            texts = [table.of(np.frombuffer(v.as_buffer(), "<u4")) if v.is_valid else None for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` binary")


def digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256 of the decimal ids joined by spaces, decoded_sha256 of the bytes that ``decode`` gives);
    decodes in place, so that decoded texts need not leave the task."""

    def run(batches):
        table = worker_state("bytes:" + ranks_path, lambda: TokenBytes(ranks_path))
        digits = worker_state("digits:" + ranks_path, lambda: table.like([b"%d " % i for i in range(len(table.lengths))]))
        sha = hashlib.sha256
        for batch in batches:
            values = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(2)]
            of_ids = [sha(digits.of(v)[:-1]).hexdigest() for v in values]
            of_text = [sha(table.of(v)).hexdigest() for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
