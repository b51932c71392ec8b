"""Each operator against a brute-force version, over real and awkward rows."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from conftest import SF

from lotwise.llm import byte_bpe, hnsw, mixing, near_copies, quality, repair, sharding, simhash, token_count, vector_dedup, warc
from lotwise.llm.queries import QUERIES, SQL


def groups(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_token_counts(odd_docs, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_count.count_tokens(odd_docs, path).collect():
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096), r.doc_id


def test_byte_bpe(odd_docs, texts):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoder(path, P.PATTERN)
    encoded = byte_bpe.encode(odd_docs.unionByName(odd_docs), path, P.PATTERN)
    got = byte_bpe.digests(encoded, path).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in byte_bpe.decode(encoded, path).select("doc_id", "decoded").collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_id_files(odd_docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in repair.round_trip(odd_docs, path).collect()}
    at = 0
    for k in sorted(texts):
        ids = library.encode(texts[k], add_special_tokens=False).ids + [2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), k
        at += len(ids)


def random_texts(n=2500, seed=11):
    """Characters of all planes, newer ones among them, runs of combining marks, marks after spaces, special strings."""
    rng = np.random.default_rng(seed)
    marks = [0x301, 0x308, 0x327, 0x338, 0x869, 0x84C, 0x898, 0x5B0, 0x94D, 0x3099]
    some = [0x1C89, 0xC5C, 0xA7CF, 0x10D56, 0x130, 0x3A3, 0x3C2, 0xDF, 0x1E9E, 0x212B, 0xAC00, 0x1100, 0x1161, 0x200B, 0xA0, 0x3000, 0x2028, 0x85]
    out = []
    for _ in range(n):
        parts = []
        for kind in rng.integers(0, 9, rng.integers(1, 14)):
            c = int(rng.integers(1, 0x11000 if kind < 2 else 0x30000))
            letters = [chr(c) if not 0xD800 <= c < 0xE000 else "x", chr(marks[c % 10]), chr(marks[c % 7]), chr(some[c % len(some)]), " ", "aB c", "'s 'LL", " <|endoftext|>", chr(97 + c % 26)]
            parts.append(letters[kind])
        out.append("".join(parts))
    return out


def test_random_unicode(spark):
    """op3, op5 and op7 against their libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    texts = random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in repair.tokenize(df, P.path("word_bpe_49k.json")).collect():
        assert np.frombuffer(r.ids, np.uint16).tolist() == library.encode(texts[r.id], add_special_tokens=False).ids + [2], texts[r.id]
    piece = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in token_count.count_tokens(df, P.path("piece_bpe_32k.model")).collect():
        assert r.n_tokens == len(piece.encode(texts[r.doc_id])), texts[r.doc_id]
    path = P.path("byte_bpe_50k.tiktoken")
    enc = byte_bpe.encoder(path, P.PATTERN)
    for r in byte_bpe.digests(byte_bpe.encode(df, path, P.PATTERN), path).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, enc.encode_ordinary(texts[r.doc_id]))).encode()).hexdigest(), texts[r.doc_id]


def test_id_files_of_null_and_repeated_ids(spark, monkeypatch):
    """Half of all rows without an id and a third with one: every row once, starts without a gap, no task with all of them."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(repair.write_files, "__defaults__", (40,))
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(None, f"none {i}") for i in range(60)] + [(4, f"four {i} times") for i in range(40)] + [(i, None if i % 2 else "") for i in range(5, 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(repair.round_trip(df, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = [(d, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for d, t in rows]
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter(crc)


def test_grammar_random_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 50, 4000), np.tile([7, 7, 7, 8], 900), [5]))
    counts = np.array([1000, 3000, 3600, 1, 0])
    shard = repair.Shard(repair.store(ids, np.arange(5), np.zeros(5, bool), counts))
    assert len(shard.seq) < len(ids) / 1.5
    assert (shard.ids() == ids).all()
    for s, n in ((0, 1), (3999, 10), (4100, 3000), (7600, 1)):
        assert (shard.span(s, n) == ids[s : s + n]).all()
    assert (shard.document(2) == ids[4000:7600]).all()
    none = repair.Shard(repair.store(ids[:0], np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)))
    assert len(none.ids()) == 0


def test_simhash(odd_docs, texts):
    keys = sorted(texts)
    fps = [simhash.fingerprint(texts[k]) for k in keys]
    near = [(a, b) for a in range(len(keys)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    root = groups(len(keys), near)
    for r in simhash.near_duplicates(odd_docs).collect():
        at = keys.index(r.doc_id)
        assert (r.fingerprint, r.component_id) == (f"{fps[at]:016x}", keys[root[at]])
    assert fps[keys.index(9_000_000)] == 0


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = {b ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)}
    signed = [simhash._signed(x) for x in fps]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    got = [tuple(r) for r in simhash.linked(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert len(got) == len(want) and set(got) == want


def five_word_groups(texts):
    """Smallest position of each text's group: sets of five-word shingles at similarity 0.8 or more, all pairs."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    same = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return groups(len(texts), same)


def planted(n=60, seed=5):
    """Documents of 60 to 400 words with copies that have 1, 2, 3 or 5 words replaced."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(60, 401))]
        rows.append(" ".join(words))
        for changes in (1, 2, 3, 5):
            copy = list(words)
            for at in rng.choice(len(words), changes, replace=False):
                copy[at] = f"x{rng.integers(0, 5000)}"
            rows.append(" ".join(copy))
    return rows


def test_near_copies_planted(spark):
    texts = planted() + [None, "", " ", "a b", "A  b", "a b c"]
    root = five_word_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in near_copies.keep_one(df).collect())
    assert kept == sorted(set(root))


def test_near_copies_of_a_dense_group(spark):
    """A chain whose ends are unlike, and a group of which most pairs are just below the similarity."""
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    texts = [" ".join(words[i * 3 : i * 3 + 100]) for i in range(30)]
    base = [f"v{x}" for x in rng.integers(0, 5000, 200)]
    for i in range(60):
        copy = list(base)
        for at in rng.choice(200, 3, replace=False):
            copy[at] = f"y{i}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(df).collect()) == sorted(set(five_word_groups(texts)))


CLASHING = [(None, "n " * 150, "p"), (None, "m " * 90, "p"), (None, "m " * 90, "p"), (7, "r1 r2 r3 " * 60, "p"), (7, "r1 r2 r3 " * 60, "p"), (7, "r1 r2 r3 " * 60, "q"),
            (8, "short one", "q"), (8, " ".join(f"long{i}" for i in range(700)), "q"), (9, None, "q"), (None, None, None), (10, "tail " * 130, None)]


def clashing(spark):
    rows = [(d, f"{t} {i}" if t and i in (0, 1) else t, "en", s, len(t or "")) for i, (d, t, s) in enumerate(CLASHING)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_near_copies_of_null_and_repeated_ids(spark):
    df, rows = clashing(spark)
    root = five_word_groups([r[1] for r in rows])
    want = []
    for g in sorted(set(root)):
        own = [r for r, x in zip(rows, root) if x == g]
        want.append(min((r[0] is None, r[0] or 0) for r in own))
    got = near_copies.keep_one(df.repartition(4)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted(want)
    texts = [r[1] for r in rows]
    assert sorted(root[texts.index(r.text)] for r in got) == sorted(set(root))


def test_mix_of_null_and_repeated_ids(spark):
    df, _ = clashing(spark)
    want = Counter((r.doc_id, r.source, r.taken) for r in mixing.mixed_sizes(df).collect() if r.taken)
    rows = mixing.mixed_texts(df).collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in rows) == want
    assert all(r.n_chars == len(r.text) for r in rows)
    again = mixing.mixed_texts(df.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_shards(odd_docs, texts):
    rows = sharding.shard_records(odd_docs, range_bytes=2000).collect()
    assert len(rows) == len(texts)
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1
        held[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(held.values()) - min(held[s] for s in range(8)) <= 2 * max(r["size"] for r in rows)


def test_shards_of_one_text(spark):
    rows = spark.createDataFrame([(i, "same text") for i in range(4000)], "doc_id long, text string")
    got = Counter(r.shard for r in sharding.shard_records(rows, range_bytes=500).collect())
    assert sorted(got) == list(range(8)) and max(got.values()) - min(got.values()) <= 1


def test_mix(odd_docs, texts):
    rows = mixing.mixed_sizes(odd_docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode().split()) and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in target)
    assert sorted(rows) == sorted(mixing.mixed_sizes(odd_docs.repartition(3)).collect())
    mixed = {r.doc_id: r.text for r in mixing.mixed_texts(odd_docs).select("doc_id", "text").collect()}
    assert {k: len(t.encode().split()) for k, t in mixed.items()} == {r.doc_id: r.taken for r in rows if r.taken}


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == pytest.approx([18.75, 7.5, 3.75])
    assert mixing.targets([1, 10, 19], [5, 2, 1]) == pytest.approx([3, 18, 9])
    for n in (1, 2, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, np.full(n, 9))) == list(range(n))


def test_quality_on_held_out_rows(spark):
    t = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{t}/{x}.parquet") for x in ("documents", "labels"))
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_of_awkward_rows(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert quality.keep_good(odd_docs, none).columns == odd_docs.columns


PAGES = [(5, "u5", "x" * 200), (3, "u3", "x" * 200), (4, None, None), (6, "a b\r\nc", "short"), (7, "u7", "short"), (8, "u8", "y\r\n\r\nWARC/1.1\r\n" * 20),
         (9, "u9", "é" * 50), (10, "u10", "é" * 50), (11, "u", "é" * 49), (12, "u", "é" * 49), (3, "u3", "x" * 200)] + [(100 + i, "hot", "z" * 500) for i in range(50)]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect())
    want = []
    for p, _, h in PAGES:
        body = (h or "").encode()
        first = min(q for q, _, g in PAGES if (g or "").encode() == body)
        again = len(body) >= 100 and first != p
        want.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    assert len(got) == len(want)
    assert sorted(got, key=str) == sorted(want, key=str)


def vectors(spark, hot=False):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(16) * 0.05 * (i % 3)], (0 if hot else i % 2) if i % 11 else None) for i in range(240)]
    rows += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, rows[1][1], 1), (305, [1.0] * 8, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


@pytest.mark.parametrize("hot", [False, True])
def test_vector_dedup(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(vector_dedup, "CELL_ROWS", 8)
    df, rows = vectors(spark, hot)

    def fine(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    at = {r[0]: i for i, r in enumerate(rows)}
    near = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] is not None and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    near.append((at[a[0]], at[b[0]]))
    root, n = groups(len(rows), near), Counter(i for p in near for i in p)
    assert len(near) > 50
    for r in vector_dedup.near_duplicates(df).collect():
        i = at[r.vec_id]
        assert (r.n_links, r.component_id, r.kept) == (n[i], rows[root[i]][0], root[i] == i), r


def test_graph_search(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.search(hnsw.build_index(df, shard_rows=1000), df.where("vec_id % 20 = 0")).collect():
        assert r.score == pytest.approx(float((x[r.query_id] * x[r.vec_id]).sum()), rel=1e-12) and r.vec_id != r.query_id
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 3000, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and [(-s_, v) for _, v, s_ in mine] == sorted((-s_, v) for _, v, s_ in mine)
        hits += len({v for _, v, _ in mine} & set(np.lexsort((np.arange(3000), -s))[:20].tolist()))
    assert len(got) == 150 and hits / 3000 >= 0.9


def test_empty_tables(spark, tmp_path):
    for t in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", list(SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


def test_vector_dedup_repeated_ids(spark):
    """One id on two vectors, on two labels, and on equal rows."""
    a, b, far = [1.0, 0.0], [1.0, 0.05], [0.0, 1.0]
    rows = [(1, a, 0), (1, b, 0), (5, b, 0), (1, far, 0), (1, a, 7), (9, b, 7), (5, far, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (5, 0, 5, True), (5, 2, 1, False), (9, 1, 1, False)]


def test_vector_dedup_sends_vectors_of_candidates_only(spark, monkeypatch):
    """Of unlike vectors nearly none travels; those in single and in double precision still meet."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 64))
    x = np.vstack([x, x[:5] * 1.0001 + 1e-3]).astype(np.float32).astype(float)
    x[3000] += 1e-9  # no longer a single-precision vector
    rows, put = {}, vector_dedup.written

    def counted(df, label):
        out = put(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(vector_dedup, "written", counted)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert {i: v for i, v in got.items() if v != (0, i)} == {i: (1, i % 3000) for i in [*range(5), *range(3000, 3005)]}
    assert rows["vectors-met"] < 400 and rows["vector-candidates"] < 1000


def test_quality_bounds_rows_of_one_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda samples: seen.extend(samples) or quality.Model(np.zeros(quality.BUCKETS, np.float32), 0.0))
    docs = spark.createDataFrame([(3, f"text {i % 7}") for i in range(300)] + [(4, "other"), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for most in (1, 2, 5):
        seen.clear()
        quality.train(docs, labels, most=most)
        assert len(seen) <= most


def plain_near_copies(rows):
    """Of (doc_id, text): the kept rows, by comparing all pairs of shingle sets."""
    def shingle_set(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingle_set(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    root, best = groups(len(rows), near), {}
    for i, r in enumerate(rows):
        best.setdefault(root[i], []).append((r[0] is None, r[0] or 0, str(r[1])))
    return sorted(min(v)[:2] for v in best.values())


def test_pipeline(spark):
    """Every stage against a plain version of it, on the documents and planted rows; then the whole chain."""
    import corpus_pipeline
    import public_tokenizers as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").where("length(text) > 900").limit(6).collect()
    planted = [(900 + i, r.text.replace(r.text.split()[40], "planted", 1), "en", "p", 1) for i, r in enumerate(first)]
    planted += [(None, first[0].text, "en", "p", 1), (None, None, "en", None, 0), (7777, "", None, None, 0), (first[1].doc_id, first[1].text, "fr", "q", 1), (first[2].doc_id, "quite another text under a used id " + first[3].text[:300], "en", "q", 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    good = corpus_pipeline.quality_stage(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, want = quality.train(docs, labels), Counter()
    for r in docs.collect():
        words = [w.encode() for w in (r.text or "").split()]
        sums, n = 0.0, 0
        for w in words:
            _, buckets = quality.word_features([w])
            sums, n = sums + float(model.parts[buckets].sum()), n + len(buckets)
        again = sum(x == y for x, y in zip(words, words[1:]))
        sums, n = sums + again * float(model.parts[quality.AGAIN]), n + again
        score = 1 / (1 + np.exp(-np.clip((sums / n if n else 0) + model.bias, -50, 50)))
        want[(r.doc_id, r.text)] += int(score >= quality.ACCEPT)
    assert good.columns == corpus_pipeline.COLUMNS
    assert Counter((r.doc_id, r.text) for r in good.collect()) == +want
    one = corpus_pipeline.near_copies_stage(spark, good, SF)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in one.collect())
    assert got == plain_near_copies([(r.doc_id, r.text) for r in good.collect()])
    mixed = corpus_pipeline.mix_stage(spark, one, SF).collect()
    words = {(r.doc_id, r.source): Counter((r.text or "").split()) for r in one.collect()}
    for r in mixed:  # only a document's own words, at most three times each of their number
        own = words[r.doc_id, r.source]
        assert set((r.text or "").split()) <= set(own) and len((r.text or "").split()) <= 3 * sum(own.values())
    enc = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plain = sorted(hashlib.sha256(" ".join(map(str, enc.encode_ordinary(r.text or ""))).encode()).hexdigest() for r in mixed)
    rows = corpus_pipeline.encode_stage(spark, corpus_pipeline.mix_stage(spark, one, SF), SF).collect()
    assert sorted(r.ids_sha256 for r in rows) == plain
    chain = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        chain = stage(spark, chain, SF)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, chain.collect()))


def test_words_encoded_together_match_the_library():
    """Short words go to the library in one text; groups whose bytes do not fall apart at the words are encoded singly."""
    import random

    import public_tokenizers

    from lotwise.llm.repair import WordIds

    known = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    spans = [(97, 122), (33, 126), (0xC0, 0x24F), (0x300, 0x36F), (0x900, 0x97F), (0x1E00, 0x1EFF), (0x10400, 0x1044F)]
    words = ["", "x" * 500, "a<|endoftext|>b", "<|startoftext|>", "İx", "ǅ", "á", "́a", "a\x1cb", "a\x85b", "it's", "tab\there"]
    for _ in range(4_000):
        lo, hi = rng.choice(spans[:2] if rng.random() < 0.7 else spans)
        words.append("".join(chr(rng.randint(lo, hi)) for _ in range(rng.randint(1, 12))))
    words = list(dict.fromkeys(words))
    alone = [e.ids for e in known.library.encode_batch(words, add_special_tokens=False)]
    got = [np.frombuffer(b, known.kind).tolist() for b in known.of(words)]
    assert got == alone
    plain = [w for w in words if w.isascii() and w.split() == [w]][:100]
    whole = known.library.encode(" ".join(plain), add_special_tokens=False).ids
    stops = known.stops(plain, np.array(whole, known.kind))
    assert stops is not None and stops[-1] == len(whole)
    assert known.stops(plain[:-1], np.array(whole, known.kind)) is None
