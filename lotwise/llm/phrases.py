"""Phrases that hold together: the best-scoring phrases of 2 to 3 words of each language, by best-first branch and bound.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at blanks and tabs. The
search tree of a language has words at its first level, pairs at the second, triples at the third; a node is expanded by
one pass over the texts that counts its continuations. Counts give bounds that no descendant can beat: a phrase occurs no
more often than its first words, so a triple scores at most a(first two) / f(first word), and a phrase with a word or a
pair under ``LEAST`` is no candidate.

First the words, then the pairs of frequent words are counted. Then a round takes the best of each open language's
frontier: T is the score of its ``TOP``-th pair (a wider frontier each round, at last everything), expanded are all pairs
whose bound reaches T, and those that a longer phrase over a pair scoring T or more may begin with (such a phrase decides
whether the pair is dropped). After that every phrase scoring T or more, ties included, is known and settled. A language
is done when ``TOP`` phrases survive at T or above, or when nothing is left to expand.

A pass counts in the tasks first; Spark adds the counts up by phrase. Which words or pairs are worth counting is told to the
tasks by a bit map of at most ``MOST_BITS`` bits over hashes: it passes every wanted one, and of others only some, whose
counts are right as well. Scores are whole numbers, worked out in decimals of 38 digits.

Null and empty texts have no words. A null language counts as ``und``. Repeated rows count as often as they occur; ids
and other columns are ignored. Ties go to the higher count, then the smaller phrase in byte order. An empty table gives
an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hot_groups
from lotwise.llm.shared import byte_slices, written

LEAST = 10
TOP = 2000
COVERED = 50  # per cent of a phrase's occurrences that a longer one must hold to drop it
WIDER = 8  # how much more of the frontier each round takes
ROUNDS = 3  # the last one expands all that is left
HELD_WORDS = 1 << 21
SLICE_BYTES = 4 << 20
MOST_BITS = 1 << 27
HOT = 1_000_000
PARTS = 64
BREAK = b"\xff"  # no byte of any text
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


def pieces(text: str | None) -> list[bytes]:
    """The words, with ``BREAK`` between pieces."""
    return (text or "").encode().translate(FOLD).replace(BREAK, b" \xff ").split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(first * np.uint64(0x9E3779B97F4A7C15) + second)


class BitMap:
    """Which (language, words) are wanted: one bit per hash value."""

    def __init__(self, bits: int, words: np.ndarray):
        self.shift, self.words = np.uint64(64 - (bits - 1).bit_length()), words

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def bit_map(wanted: DataFrame) -> BitMap:
    """Of (lang, phrase); the driver receives at most ``MOST_BITS`` / 64 numbers."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, wanted.count()) - 1).bit_length()))
    shift = np.uint64(64 - (bits - 1).bit_length())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            h = _word_hashes([v.encode() for v in batch.column(0).to_pylist()])
            lists = pc.split_pattern(batch.column(1), " ")
            words, n = _word_hashes([v.encode() for v in lists.flatten().to_pylist()]), np.asarray(pc.list_value_length(lists))
            starts = np.cumsum(n) - n
            for k in range(int(n.max())):
                more = n > k
                h[more] = _joined(h[more], words[starts[more] + k])
            at = h >> shift
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["slot", "bits"])

    table = wanted.select("lang", "phrase").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return BitMap(bits, words)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _counted(lang: str, words: list[bytes], strings: pa.Array, h: np.ndarray, parts: list[np.ndarray], size: int, first, second):
    """(phrase, n) of the phrases of ``size`` words in the code lists; code 0 is a break."""
    c = np.concatenate(parts)
    if size == 1:
        n = np.bincount(c, minlength=len(words))
        n[0] = 0
        got = np.flatnonzero(n)
        return strings.take(pa.array(got)), n[got]
    own = _word_hashes([lang.encode()])
    level = _joined(np.repeat(own, len(h)), h)  # the hash of (lang, word)
    if size == 2:
        good = first.passes(level)
        good[0] = False
        at = np.flatnonzero(good[c[:-1]] & good[c[1:]])
        key, n = np.unique(c[at].astype(np.int64) * len(words) + c[at + 1], return_counts=True)
        codes = (key // len(words), key % len(words))
    else:
        at = np.flatnonzero((c[:-1] > 0) & (c[1:] > 0))
        pair, of = np.unique(c[at].astype(np.int64) * len(words) + c[at + 1], return_inverse=True)
        hashes = _joined(level[pair // len(words)], h[pair % len(words)])
        opens, goes_on = first.passes(hashes), second.passes(hashes)
        begins = np.flatnonzero(opens[of][:-1] & goes_on[of][1:] & (at[1:] == at[:-1] + 1))
        key, n = np.unique(of[begins].astype(np.int64) * len(words) + c[at[begins] + 2], return_counts=True)
        codes = (pair[key // len(words)] // len(words), pair[key // len(words)] % len(words), key % len(words))
    return pc.binary_join_element_wise(*[strings.take(pa.array(x)) for x in codes], " "), n


def counted(docs: DataFrame, size: int, first: BitMap | None = None, second: BitMap | None = None) -> DataFrame:
    """(lang, phrase, a): occurrences of phrases of ``size`` words. Pairs: of words that ``first`` passes. Triples: whose
    first two words pass ``first`` and whose last two pass ``second``."""
    plain = [m and (64 - int(m.shift), m.words) for m in (first, second)]  # only arrays: a broadcast is not pickled by value
    maps = docs.sparkSession.sparkContext.broadcast(plain) if first else None

    def run(batches):
        opens, goes_on = (m and BitMap(1 << m[0], m[1]) for m in (maps.value if maps else (None, None)))
        known, held, words = _Codes({BREAK: 0}), {}, 0

        def empty():
            names = list(known)
            strings = pa.array([b"", *names[1:]], pa.binary()).cast(pa.string())
            h = _word_hashes(names)
            for lang, parts in held.items():
                phrase, n = _counted(lang, names, strings, h, parts, size, opens, goes_on)
                for s in range(0, len(n), 1 << 16):
                    p = phrase.slice(s, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(p), np.int32))), p, pa.array(n[s : s + (1 << 16)].astype(np.int64))], ["lang", "phrase", "n"])

        for whole in batches:
            for batch in byte_slices(whole, "text", SLICE_BYTES):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    found = pieces(text.as_py())
                    found.append(BREAK)
                    held.setdefault(lang, []).append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    words += len(found)
                if words >= HELD_WORDS:
                    yield from empty()
                    known, held, words = _Codes({BREAK: 0}), {}, 0
        yield from empty()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(run, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def score(a: str, l: str, r: str) -> Column:
    """floor(1000000 a a / (l r))."""
    big = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({big(a)} * {big(a)} * cast(1000000 as decimal(7,0))) div ({big(l)} * {big(r)})")


def _pairs(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates of two words: (lang, phrase, w1, w2, a, l, r, score, bound)."""
    found = written(counted(docs, 2, bit_map(words)).where(F.col("a") >= LEAST), "pairs")
    split = found.select("lang", "phrase", F.split("phrase", " ").alias("w"), "a").select("lang", "phrase", F.col("w")[0].alias("w1"), F.col("w")[1].alias("w2"), "a")
    left, right = words.toDF("lang", "w1", "l"), words.toDF("lang", "w2", "r")
    out = split.join(left, ["lang", "w1"]).join(right, ["lang", "w2"])
    bound = F.expr("a * 1000000 div l")  # of a longer phrase that begins so
    return written(out.select("lang", "phrase", "w1", "w2", "a", "l", "r", score("a", "l", "r").alias("score"), bound.alias("bound")), "scored-pairs")


def _triples(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates of three words with their lowest-scoring cut."""
    w = F.split("phrase", " ")
    split = found.select("lang", "phrase", "a", w[0].alias("w1"), w[2].alias("w3"), F.concat_ws(" ", w[0], w[1]).alias("p12"), F.concat_ws(" ", w[1], w[2]).alias("p23"))
    few = pairs.select("lang", "phrase", "a")
    out = split.join(few.toDF("lang", "p12", "f12"), ["lang", "p12"]).join(few.toDF("lang", "p23", "f23"), ["lang", "p23"])
    out = out.join(words.toDF("lang", "w1", "f1"), ["lang", "w1"]).join(words.toDF("lang", "w3", "f3"), ["lang", "w3"])
    out = out.withColumns({"one": score("a", "f1", "f23"), "two": score("a", "f12", "f3")})
    cut = lambda x, y: F.when(F.col("two") < F.col("one"), F.col(y)).otherwise(F.col(x))
    return out.select("lang", "phrase", "p12", "p23", "a", cut("f1", "f12").alias("l"), cut("f23", "f3").alias("r"), F.least("one", "two").alias("score"))


def _surviving(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """All known phrases but the pairs that a triple covers."""
    inside = triples.select("lang", F.explode(F.array("p12", "p23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = pairs.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVERED * F.col("a")))
    names = ["lang", "phrase", "a", "l", "r", "score"]
    return free.select(*names).unionByName(triples.select(*names))


def phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` surviving phrases."""
    counts = written(counted(docs, 1), "words")
    sizes = written(counts.groupBy("lang").agg(F.sum("a").alias("n")), "language-sizes")
    words = written(counts.where(F.col("a") >= LEAST), "frequent-words")
    pairs = _pairs(docs, words)
    second = bit_map(pairs)
    hot = hot_groups(pairs, ["lang"], HOT)
    open_, found, expanded, floors = sizes.select("lang"), None, None, None
    for i in range(ROUNDS):
        floors_now = _floors(pairs, open_, top * WIDER**i if i < ROUNDS - 1 else None)
        nodes = written(_frontier(attach(pairs, floors_now, ["lang"], hot), expanded), "frontier")
        more = _triples(counted(docs, 3, bit_map(nodes), second).where(F.col("a") >= LEAST), words, pairs)
        found = written(more if found is None else found.unionByName(more).dropDuplicates(["lang", "phrase"]), "triples")
        expanded = nodes if expanded is None else expanded.unionByName(nodes)
        settled = attach(_surviving(pairs, found), floors_now, ["lang"], hot).where("score >= floor")
        done = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
        done = written(floors_now.join(done, "lang", "left").where((F.col("have") >= top) | (F.col("floor") == 0)).select("lang", "floor"), "settled")
        floors = done if floors is None else floors.unionByName(done)
        open_ = written(open_.join(done, "lang", "left_anti"), "open")
        if open_.isEmpty():
            break
    best = attach(_surviving(pairs, found), floors, ["lang"], hot).where("score >= floor")
    for spread in (F.pmod(F.xxhash64("phrase"), F.lit(PARTS)), F.lit(0)):  # first the best of each part of a language
        order = Window.partitionBy("lang", "part").orderBy(F.desc("score"), F.desc("a"), F.col("phrase"))
        best = best.withColumn("part", spread.cast("int")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _floors(pairs: DataFrame, open_: DataFrame, want: int | None) -> DataFrame:
    """(lang, floor) of the open languages: the score of the ``want``-th pair, 0 where there are fewer."""
    if want is None:
        return open_.select("lang", F.lit(0).cast("long").alias("floor"))
    steps = pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))  # scores are 0 to 1000000, so a language has few
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    last = steps.withColumn("have", above).where(F.col("have") >= want).groupBy("lang").agg(F.max("score").alias("low"))
    low = F.col("low")
    return written(open_.join(last, "lang", "left").select("lang", F.coalesce(low, F.lit(0).cast("long")).alias("floor")), "floors")


def _frontier(pairs: DataFrame, expanded: DataFrame | None) -> DataFrame:
    """Pairs (with ``floor``) to expand: those whose bound reaches the floor, and those before a pair that does, where a
    triple over both can be frequent enough to drop it."""
    need = pairs.where("score >= floor").groupBy("lang", F.col("w1").alias("w2")).agg(F.min("a").alias("least"))
    nodes = pairs.join(need, ["lang", "w2"], "left").where((F.col("bound") >= F.col("floor")) | (100 * F.col("a") >= COVERED * F.col("least"))).select("lang", "phrase")
    return nodes if expanded is None else nodes.join(expanded, ["lang", "phrase"], "left_anti")
