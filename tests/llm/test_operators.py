"""The ten operators against brute-force versions and on awkward inputs."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A
from corpuscle.llm import bpe, decontamination, flac, language, paragraphs, prefix_free, superminhash, url_filters, warc
from corpuscle.llm._spark import Tables, components
from corpuscle.llm.token_store import ByteBpe, TokenStore, shift_crc
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, score double"
AWKWARD = [
    (1, None, "x", 1.0), (2, "", "x", 1.0), (3, "  \n\t ", None, None), (4, "one", "x", 1.0), (5, "one", "x", 1.0), (5, "one", "x", 1.0),
    (None, "one two three four five six", "x", 1.0), (6, "Ünïcode ἀρχή 日本語 🙂   é", "x", 1.0), (7, "word " * 30_000, "x", 1.0), (8, "a\0b \x1c c", "x", 1.0),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    public = pytest.importorskip("public_tokenizers")
    return public.path(name)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", ["op1_warc_archives", "op6_superminhash_near_dedup", "op7_prefix_free_dedup", "op9_temporal_url_filters"])
def test_query_equals_sql(spark, con, name):
    from corpuscle.llm import queries

    assert compare(queries.QUERIES[name](spark, SF), con, queries.SQL[name]) > 0


# 1. WARC


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_is_read_by_others_and_by_us(tmp_path, zip64):
    raw = warc.zip_stored([("a.txt", b"alpha"), ("ü/b", b"")], zip64)
    path = tmp_path / "x.zip"
    path.write_bytes(raw)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.read("a.txt") == b"alpha" and z.read("ü/b") == b""
    at, n = warc.zip_directory(lambda a, n: raw[a : a + n], len(raw))["a.txt"]
    assert raw[at : at + n] == b"alpha"


def test_zip_with_comment_and_packed_member(tmp_path):
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("packed", b"x" * 1000)
        z.writestr(zipfile.ZipInfo("stored"), b"abc", zipfile.ZIP_STORED)
        z.comment = b"PK\5\6 a comment"
    raw = path.read_bytes()
    found = warc.zip_directory(lambda a, n: raw[a : a + n], len(raw))
    assert set(found) == {"stored"} and raw[found["stored"][0] :][:3] == b"abc"


def test_warc_round_trip_and_revisits(spark, tmp_path):
    rows = [(1, "http://a/x y", "same"), (2, "http://b/\n", "same"), (3, None, None), (4, "u", ""), (5, "u", "é🙂\r\n\r\nz"), (6, "v", "same")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("revisit", 3), 5: ("response", None), 6: ("revisit", 1)}
    assert got[5]["payload_bytes"] == len("é🙂\r\n\r\nz".encode()) and got[2]["payload_bytes"] == 4
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=5).collect()} == {"response"}
    held = warc.archives(Tables(spark, "t"), pages).collect()
    (tmp_path / "a.wacz").write_bytes(bytes(held[0]["content"]))
    back = warc.read_archive_files(spark, str(tmp_path), payloads=True).collect()
    assert {bytes(r["payload"]).decode() for r in back if r["page_id"] == 5} <= {"é🙂\r\n\r\nz"}


def test_damaged_archives_are_refused():
    with pytest.raises(ValueError, match="central directory"):
        warc.zip_directory(lambda a, n: b"nothing here"[a : a + n], 12)


# 2. language


def test_languages_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    calibrated = out.agg(F.avg("score")).first()[0]
    assert abs(calibrated - right) < 0.05


def test_language_of_awkward_texts(spark, awkward, nothing):
    labelled = awkward.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("xx"))
    out = {(r["doc_id"], r["lang_pred"] == "und") for r in language.identify(labelled).collect()}
    assert {(1, True), (2, True), (3, True)} <= out and (4, True) not in out
    assert language.identify(nothing.withColumn("lang", F.lit("en"))).count() == 0
    unlabelled = language.identify(awkward.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    clash = awkward.withColumns({"lang": F.lit("en"), "lang_pred": F.lit("mine")})
    assert language.accepted(clash, 0.0).columns == clash.columns


# 3. BPE


def random_texts(n, seed=1):
    rng = random.Random(seed)
    letters = list("abcdetho '.,!?1\n\t-") + ["é", "ß", "Σ", "İ", "́", "日", "🙂", "'s", " the", "<|endoftext|>", " ", "\x1c", "ა"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_word_bpe_equals_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    own, library = bpe.WordBpe(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    texts = random_texts(3000)
    for text, ids in zip(texts, own.encode_texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_on_awkward_rows(awkward, nothing):
    path = tokenizer("word_bpe_49k.json")
    rows = bpe.encode(awkward, path).collect()
    assert len(rows) == len(AWKWARD) and [r["ids"] for r in rows if r["doc_id"] in (1, 2, 3)] == [[], [], []]
    assert bpe.digests(nothing, path).count() == 0


# 4. FLAC


def scalar_flac(stream: bytes) -> bytes:
    """A plain bit-by-bit decoder, after the format's description."""
    total, _, _, at = flac.read_metadata(stream)
    bits = "".join(f"{b:08b}" for b in stream[at:])
    p, out = 0, []

    def take(n):
        nonlocal p
        p += n
        return int(bits[p - n : p] or "0", 2)

    def signed(n):
        v = take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    while len(out) < total:
        assert take(16) == 0xFFF8
        take(16)
        lead = take(8)
        while lead & 0x40 and lead & 0x80:
            take(8)
            lead = (lead << 1) & 0xFF
        size = take(16) + 1
        take(8)
        take(1)
        kind = take(6)
        take(1)
        if kind == 0:
            x = [signed(8)] * size
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [signed(8) for _ in range(order)]
            shift, coefs = 0, flac._FIXED[order] if kind < 16 else None
            if coefs is None:
                precision, shift = take(4) + 1, take(5)
                coefs = [signed(precision) for _ in range(order)]
            take(2)
            parts = 1 << take(4)
            for part in range(parts):
                k = take(4)
                for _ in range(size // parts - (order if part == 0 else 0)):
                    q = bits.index("1", p) - p
                    p += q + 1
                    z = (q << k) | take(k)
                    r = z >> 1 if z % 2 == 0 else -(z >> 1) - 1
                    x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
        out += x
        p += -p % 8
        take(16)
    return bytes(v + 128 for v in out)


def test_flac_round_trips_and_agrees_with_a_scalar_decoder():
    rng = np.random.default_rng(3)
    texts = ["", "abc", "a" * 5000, "héllo wörld " * 400, "x" * 64, "".join(map(chr, rng.integers(32, 400, 9000))), "ab" * 3000]
    for _, _, payload, offs, _ in flac.padded(pa.array([*texts, None])):
        streams, _ = flac.encode(payload, offs)
        assert (flac.decode(streams) == payload).all()
        for k, s in enumerate(streams):
            assert scalar_flac(s) == payload[offs[k] : offs[k + 1]].tobytes()


def test_flac_detects_damage():
    _, _, payload, offs, _ = next(flac.padded(pa.array(["some text that is long enough to have residuals " * 20])))
    stream = bytearray(flac.encode(payload, offs)[0][0])
    stream[-10] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode([bytes(stream)])


def test_flac_queries_on_awkward_rows(awkward, nothing):
    media = flac.to_media(awkward)
    rows = flac.features(media).collect()
    assert len(rows) == len(AWKWARD)
    for r, (_, text, *_) in zip(rows, AWKWARD, strict=True):
        raw = (text or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    blocks = flac.pcm_blocks(media.where("doc_id = 7")).orderBy("block").collect()
    assert [b["first_sample"] for b in blocks] == [flac.FRAME * k for k in range(len(blocks))]
    assert b"".join(bytes(b["pcm"]) for b in blocks).rstrip(b"\0").decode() == "word " * 30_000
    assert flac.features(flac.to_media(nothing)).count() == 0


# 5. token store


def test_byte_bpe_equals_the_library():
    path = tokenizer("byte_bpe_50k.json")
    own = ByteBpe(open(path, encoding="utf-8").read(), most=500)
    texts = random_texts(2000, 7) + ["plain words in a row", "two\nlines", " lead", "trail ", "", "a  b"]
    for i, j, data, offs in A.blocks(pa.array(texts), 5000):
        ids, ptr = own.encode(data, offs)
        for r in range(j - i):
            assert ids[ptr[r] : ptr[r + 1]].tolist() == own.tokenizer.encode(texts[i + r], add_special_tokens=False).ids, texts[i + r]


def test_token_store_reads_back(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 120")
    docs = docs.unionByName(awkward.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    store = TokenStore(spark, Tables(spark, "test-store").root).write(docs, path, buckets=5)
    assert store.verify()
    chunks = store.chunks().agg(F.count("*"), F.countDistinct("chunk")).first()
    assert chunks[0] == chunks[1] > 0
    library, at = Tokenizer.from_file(path), 0
    want = []
    for doc, text in sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0])):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0], r[1])
    assert sorted((tuple(r) for r in store.documents().collect()), key=key) == sorted(want, key=key)
    some = {r["doc_id"]: r["ids"] for r in store.ids(docs.select("doc_id").where("doc_id in (3, 1007)")).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(ids == [*library.encode(text[d], add_special_tokens=False).ids, 0] for d, ids in some.items()) and len(some) == 2
    empty = TokenStore(spark, Tables(spark, "test-empty").root).write(nothing, path)
    assert empty.documents().count() == 0 and empty.verify()


def test_crc_parts_add_up():
    rng = random.Random(0)
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 3000)) for _ in range(rng.randint(1, 6))]
        after = [sum(map(len, parts[k + 1 :])) for k in range(len(parts))]
        crcs = shift_crc(np.array([zlib.crc32(p) for p in parts]), np.array(after))
        assert int(np.bitwise_xor.reduce(crcs)) == zlib.crc32(b"".join(parts))


# 6. near duplicates


def brute_components(rows, n, percent):
    sets = {}
    for doc, text in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).encode().split()
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, n, percent):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choices(words, k=rng.choice([4, 30, 90, 200])) for _ in range(12)]
    rows = []
    for i in range(260):
        t = list(base[i % len(base)])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(900, ""), (901, None), (902, "A b"), (903, "a B"), (904, "b a")]
    out = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, n, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_superminhash_registers_equal_a_plain_version():
    rng, m = np.random.default_rng(0), 24
    for size in (1, 3, 10, 60, 400):
        values = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
        got = superminhash.signatures(values, np.array([0, len(values)]), m)[0]
        want = [2**64 - 1] * m
        for h in A.mix(values):
            p = list(range(m))
            for j in range(m):
                offer, k = superminhash._draw(np.array([h]), j, m)
                p[j], p[int(k[0])] = p[int(k[0])], p[j]
                want[p[j]] = min(want[p[j]], int(offer[0]))
        assert got.tolist() == want


def test_similarity_is_estimated():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, k).astype(np.uint64) for k in (800, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sig = superminhash.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.06


def test_near_duplicates_on_awkward_rows(awkward, nothing):
    rows = superminhash.near_duplicates(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in rows}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (None, None, True)} <= got
    assert superminhash.near_duplicates(nothing).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["id"]: r["component"] for r in components(Tables(spark, "cc"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


@pytest.mark.parametrize(("pairs", "writes"), [([], 2), ([(9, 2), (2, 9), (7, 2), (2, 7), (4, 4), (8, 3)], 2), ([(1, 2), (2, 3), (3, 4)], 10)])
def test_components_spend_no_round_on_settled_edges(spark, monkeypatch, pairs, writes):
    """Two tables say that stars are settled, where two rounds of four tables did; repeated and reversed edges change nothing."""
    names, original = [], Tables.write
    monkeypatch.setattr(Tables, "write", lambda self, df, name, **options: names.append(name) or original(self, df, name, **options))
    got = {r["id"]: r["component"] for r in components(Tables(spark, "cc"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    least = {x: x for pair in pairs for x in pair if pair[0] != pair[1]}
    for _ in least:
        for x, y in pairs:
            if x != y:
                least[x] = least[y] = min(least[x], least[y])
    assert got == least and len(names) <= writes


# 7. repeated strings


def brute_repeats(rows, length):
    seen, gone = {}, {}
    texts = {d: (t or "").encode() for d, t in rows}
    for d in sorted(texts):
        t, cover = texts[d], bytearray(len(texts[d]))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                cover[p : p + length] = b"\1" * length
            else:
                seen[t[p : p + length]] = d
        gone[d] = bytes(b for b, c in zip(t, cover, strict=True) if not c)
    return gone


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    original = prefix_free.repeats
    monkeypatch.setattr(prefix_free, "repeats", lambda tables, docs, length: original(tables, docs, length, hot))
    rng = random.Random(11)
    pieces = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(20, 200))) for _ in range(30)]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [(500, "a" * 900), (501, "ab" * 300), (502, "a" * 150), (503, None), (504, "x" * 99), (505, "x" * 100), (506, "x" * 100)]
    out = prefix_free.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in out} == brute_repeats(rows, 100)


def test_repeats_on_awkward_rows(awkward, nothing):
    rows = prefix_free.deduplicated(awkward, digest=True).collect()
    assert len(rows) == len(AWKWARD) and [r["n_bytes"] for r in rows if r["doc_id"] == 1] == [0]
    assert next(r["n_removed"] for r in rows if r["doc_id"] == 7) == len("word ") * 30_000 - 5
    assert prefix_free.deduplicated(nothing).count() == 0


# 8. decontamination


def test_alignment_by_hand():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 7, 4, 5, 9])
    assert decontamination.align(a, b)[:2] == (3.5, 4)
    assert decontamination.align(a, np.array([1, 2, 8, 3, 4, 5])) == (4.5, 5, 0, 6)
    assert decontamination.align(a, np.array([1, 2, 4, 5])) == (3.5, 4, 0, 4)
    assert decontamination.align(a, np.array([7, 8]))[0] == 0


def brute_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
    return h.max()


def test_alignment_score_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 18))
        assert abs(decontamination.align(a, b)[0] - brute_alignment(a, b)) < 1e-9


def test_leaks_are_found_and_clean_documents_left(spark, awkward, nothing):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(90, None), (None, "x y z w v")]
    filler = lambda: " ".join(rng.choices(words, k=200))
    rows, want = [(i, filler()) for i in range(60)], set()
    for i in range(20):
        t = items[i][1].split()
        if i % 2:  # an edited copy
            for k in (4, 11, 12, 20):
                t[k] = "other"
            del t[15]
        rows.append((100 + i, f"{filler()} {' '.join(t).upper()}, {filler()}"))
        want.add((100 + i, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench, block_items=5).collect()} == want
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == set(range(60))
    assert decontamination.leaks(awkward, bench).count() == 0 and decontamination.leaks(nothing, bench).count() == 0
    assert decontamination.leaks(docs, bench.where("item_id < 0")).count() == 0


def test_edited_copies_are_found_by_any_surviving_words(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(5000)]
    rows, items = [], []
    for i in range(20):
        t = [f"item{i}w{k}" for k in range(40)]
        items.append((i, " ".join(t)))
        for k in (*range(0, 20, 4), *range(20, 35, 3)):  # 4-grams survive in the last five words alone
            t[k] = "other"
        rows.append((i, " ".join(rng.choices(words, k=50) + t + rng.choices(words, k=50))))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()} == {(i, i) for i in range(20)}


def test_copies_with_long_insertions_are_aligned_whole(spark):
    item = [f"item{k}" for k in range(40)]
    copy = item[:15] + [f"in{k}" for k in range(17)] + item[15:25] + [f"on{k}" for k in range(17)] + item[25:]
    spread = item[:13] + [f"in{k}" for k in range(38)] + item[13:]
    rows = [(1, " ".join([f"a{k}" for k in range(60)] + copy + [f"b{k}" for k in range(60)])), (2, " ".join(copy)), (3, " ".join(spread))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: (r["score"] * 40, r["byte_end"] - r["byte_start"]) for r in decontamination.leaks(docs, bench).collect()}
    assert found == {1: (23.0, len(" ".join(copy))), 2: (23.0, len(" ".join(copy))), 3: (27.0, len(" ".join(item[13:])))}


# 9. URL filters


def test_verdicts_by_date_and_pattern(spark, nothing):
    entries = spark.createDataFrame([("l", "a.com", "block", "2024-02-01"), ("l", "a.com", "drop", "2024-04-01"), ("m", "x.a.com", "allow", "2024-03-01"), ("m", "a.com/p", "block", "2024-01-01"), (None, "a.com", "block", "2020-01-01")], "list string, pattern string, action string, dated string")
    captures = spark.createDataFrame([(1, "http://A.com/", "2024-01-31"), (2, "http://a.com/", "2024-02-01"), (3, "https://u@x.a.com:8/q", "2024-03-05"), (4, "http://x.a.com/", "2024-02-15"), (5, "http://a.com/p?x", "2024-05-01"), (6, None, "2024-02-02"), (7, "http://a.com/", None), (8, "http://a.com", "2024-04-01")], "page_id long, url string, fetched string")
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in url_filters.judged(captures.withColumn("list", F.lit("mine")), entries).collect()}
    assert got == {1: ("keep", None), 2: ("block", "a.com"), 3: ("allow", "x.a.com"), 4: ("block", "a.com"), 5: ("block", "a.com/p"), 6: ("keep", None), 7: ("keep", None), 8: ("keep", None)}
    assert url_filters.judged(captures.where("page_id < 0"), entries).count() == 0


# 10. paragraphs


def test_repeated_passages_are_cut_wherever_they_stand(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(words, k=60))
    rows = [(i, " ".join(rng.choices(words, k=120)) + "\n" + " ".join(rng.choices(words, k=40))) for i in range(30)]
    for i in range(5):
        t = rows[i * 4][1].split(" ")
        k = rng.randrange(len(t))
        rows.append((100 + i, " ".join(t[:k]).replace("w", "v") + " " + passage + " " + " ".join(t[k:]).replace("w", "u")))
    line = rng.choices(words, k=40)
    rows += [(200, "first\n" + " ".join(line)), (201, "second\n" + " ".join([*line[:38], "changed", line[39]]))]
    out = {r["doc_id"]: r for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i]["n_removed_words"] == 0 and out[i]["text"] == dict(rows)[i] for i in [*range(30), 100, 200])
    for i in (101, 102, 103, 104):
        assert out[i]["linked"] == [100] and out[i]["n_removed_words"] >= 30 and passage not in out[i]["text"]
    assert out[201]["text"] == "second\n" and out[201]["linked"] == [200]


def test_passages_are_cut_to_their_ends(spark):
    rows = []
    for i in range(12):
        passage = [f"p{i}w{k}" for k in range(51)]
        for copy in range(2):
            rows.append((100 * copy + i, " ".join([f"a{i}c{copy}w{k}" for k in range(60)] + passage) + "\n" * (i % 2) + " " + " ".join(f"b{i}c{copy}w{k}" for k in range(60))))
    out = {r["doc_id"]: r for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(12):
        assert out[i]["text"] == rows[2 * i][1]
        assert out[100 + i]["n_removed_words"] == 51 and f"p{i}w" not in out[100 + i]["text"]


def test_short_lines_are_matched_exactly_and_nearly(spark):
    lines = {k: [f"l{k}w{i}" for i in range(k)] for k in (5, 9, 13, 19)}
    text = lambda name, edit: "\n".join(" ".join([f"{name}{k}", f"{name}{k}b"]) + "\n" + " ".join(w if not edit or k < 13 else [*w[:-1], "changed"]) for k, w in lines.items())
    rows = [(1, text("a", False)), (2, text("b", False)), (3, text("c", True))]
    out = {r["doc_id"]: r for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1]
    for i in (2, 3):
        assert out[i]["n_removed_words"] == 46 and 1 in out[i]["linked"] and "l13w1" not in out[i]["text"]


def test_paragraphs_on_awkward_rows(awkward, nothing):
    clash = awkward.withColumn("linked", F.lit("mine"))
    out = paragraphs.deduplicated(clash).collect()
    assert len(out) == len(AWKWARD)
    assert [r["text"] for r in out if r["doc_id"] == 1] == [None] and [r["text"] for r in out if r["doc_id"] == 3] == ["  \n\t "]
    assert next(r["n_removed_words"] for r in out if r["doc_id"] == 7) > 29_000  # one word over and over
    assert paragraphs.deduplicated(nothing).count() == 0


def test_words_shorter_and_longer_than_blocks():
    texts = pa.array(["a b", None, "x" * 5000, "", "c"])
    seen = [(i, j) for i, j, _, _ in A.blocks(texts, 16)]
    assert [i for i, _ in seen] == [0, *[j for _, j in seen][:-1]] and seen[-1][1] == 5


def test_a_full_store_of_words_keeps_giving_the_same_ids():
    from corpuscle.llm.pretokens import PretokenIds

    store = PretokenIds(lambda words: [[ord(c) for c in w] for w in words], most=5)
    rng = random.Random(2)
    for _ in range(200):
        rows = [["".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(rng.randint(0, 4))] for _ in range(2)]
        store.learn(rows)
        assert [store.ids(r).tolist() for r in rows] == [[ord(c) for w in r for c in w] for r in rows]


# cases of the second round


def gzip_record(kind, record_id, url, body, **more):
    head = {"WARC-Type": kind, "warc-record-id": record_id, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "Content-Length": len(body)} | more
    return gzip.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n").encode() + body + b"\r\n\r\n")


def published_archive(path, deflate=False):
    """An archive in its published form: two data members, a gzip index, offsets as text, ids of the urn:uuid kind."""
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    first = [gzip_record("response", "<urn:uuid:1>", "http://a/", http + b"alpha"), gzip_record("request", "<urn:uuid:2>", "http://a/", b"GET / HTTP/1.1\r\n\r\n")]
    digest = warc.payload_digest(hashlib.sha1(b"beta").hexdigest())
    second = [gzip_record("response", "<urn:uuid:3>", "http://b/", http + b"beta", **{"WARC-Payload-Digest": f"sha1:{digest}"}), gzip_record("revisit", "<urn:uuid:4>", "http://c/", b"", **{"WARC-Refers-To": "<urn:uuid:3>", "WARC-Payload-Digest": f"sha1:{digest}"})]
    lines = ["!meta {}"]
    for name, records in (("rec-1.warc.gz", first), ("rec-2.warc.gz", second)):
        at = 0
        for r in records:
            lines.append(f"com,a)/ 20240101000000 {json.dumps({'url': 'http://a/', 'offset': str(at), 'length': str(len(r)), 'filename': name})}")
            at += len(r)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("datapackage.json", "{}" * 100)
        z.writestr(zipfile.ZipInfo("indexes/index.cdx.gz"), gzip.compress("\n".join(lines).encode()), zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("archive/rec-1.warc.gz"), b"".join(first), zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo("archive/rec-2.warc.gz"), b"".join(second), zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED)


def test_published_archives_are_read_by_ranges(spark, tmp_path):
    published_archive(tmp_path / "x.wacz")
    (tmp_path / "other.txt").write_text("no archive")
    rows = {r["record_id"]: r for r in warc.read_archive_files(spark, str(tmp_path), payloads=True).collect()}
    assert {k[10:-1]: (r["record_type"], bytes(r["payload"]), r["digest_ok"]) for k, r in rows.items()} == {
        "1": ("response", b"alpha", None), "2": ("request", b"", None), "3": ("response", b"beta", True), "4": ("revisit", b"", None),
    }
    last = rows["<urn:uuid:4>"]
    assert (last["refers_to_id"], last["refers_to"], last["page_id"], last["payload_bytes"]) == ("<urn:uuid:3>", None, None, None)
    published_archive(tmp_path / "x.wacz", deflate=True)
    with pytest.raises(ValueError, match="no stored data member"):
        list(warc.record_ranges(*reader((tmp_path / "x.wacz").read_bytes())))


def reader(raw):
    return lambda at, n: raw[at : at + n], len(raw)


def test_only_ranges_of_an_archive_are_read():
    body = b"".join(zlib.compress(bytes(1000)) for _ in range(10))
    record = gzip_record("response", "<urn:uuid:1>", "u", b"HTTP/1.1 200 OK\r\n\r\nx")
    index = f"u 2024 {json.dumps({'offset': 5_000_000, 'length': len(record), 'filename': 'd.warc.gz'})}\n".encode()
    raw = warc.zip_stored([("archive/d.warc.gz", bytes(5_000_000) + record + body), ("indexes/i.cdxj", index)], zip64=True)
    read = []
    rows = list(warc.read_archive(lambda at, n: read.append(n) or raw[at : at + n], len(raw)))
    assert [p for _, _, p in rows] == [b"x"] and sum(read) < 200_000


def test_long_words_that_a_polynomial_can_not_tell_apart(spark):
    from tokenizers import Tokenizer

    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rolling = A.RollingHash(np.frombuffer((a + b).encode(), np.uint8))
    assert rolling(np.array([0]), np.array([2048])) == rolling(np.array([2048]), np.array([4096]))
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}")], "doc_id long, text string").coalesce(1)
    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode(docs, path).collect():
        assert r["ids"] == library.encode({1: a, 2: b, 3: f"{a} {b}"}[r["doc_id"]], add_special_tokens=False).ids
    path = tokenizer("byte_bpe_50k.json")
    own, library = ByteBpe(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    ids, ptr = own.encode(*A.binary_parts(pa.array([f"x {a}", f"x {b}"])))
    assert [ids[ptr[k] : ptr[k + 1]].tolist() for k in (0, 1)] == [library.encode(f"x {t}", add_special_tokens=False).ids for t in (a, b)]
    assert {r["component_id"] for r in superminhash.near_duplicates(docs, 3, 85).collect()} == {1, 2, 3}


def test_parts_of_one_hash_are_encoded_by_themselves(monkeypatch):
    from corpuscle.llm.pretokens import PartIds

    def weak(self, data, start, end):
        raw = data.tobytes()
        parts = [raw[a:b] for a, b in zip(start, end, strict=True)]
        return np.array([len(p) for p in parts], dtype=np.uint64), np.array([sum(p) for p in parts], dtype=np.uint64)

    monkeypatch.setattr(PartIds, "_hashes", weak)
    store = PartIds(100)
    for text in (b"ab cd ab e", b"e cd zz ab", b"q q"):
        data = np.frombuffer(text, np.uint8)
        start, end, _ = A.word_spans(data, np.array([0, len(data)]))

        def encode(new, data=data, start=start, end=end):
            lists = [data[start[k] : end[k]].astype(np.int64) for k in new]
            return np.concatenate(lists), np.array([len(x) for x in lists])

        ids, sizes = store.ids(data, start, end, encode)
        assert ids.tolist() == [b for b in text if b != 32] and sizes.tolist() == [len(w) for w in text.split()]


def test_digests_of_ids_and_decoded_texts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in bpe.digests(docs, path).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_every_language_is_learned_and_dealing_rows_changes_nothing(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("".join(rng.choices("abcdefghij"[g % 8 : g % 8 + 3], k=4)) for _ in range(12)), f"l{g}") for g in range(230) for k in range(6 * g, 6 * g + 6)]
    rows += [(k, t[::-1], g) for k, t, g in rows[:40]] + rows[:10]  # ids that repeat, with other texts and with the same
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language.fit(docs.repartition(n, "text"), epochs=1) for n in (2, 5)]
    assert len(models[0].langs) == 230
    assert (models[0].weights == models[1].weights).all() and models[0].temperature == models[1].temperature


def test_ftrl_step_and_tfidf_by_hand():
    learner = language.Ftrl(2, alpha=0.5, beta=1.0, l1=0.02, l2=0.1)
    learner.step(np.array([3]), np.array([2.0]), 0)
    g = 2.0 * (0.5 - 1)  # of class 0: x (p - y)
    assert np.isclose(learner.z[3, 0], g) and np.isclose(learner.n[3, 0], g * g)
    want = -(g + 0.02) / ((1 + abs(g)) / 0.5 + 0.1)
    assert np.isclose(learner.weights(np.array([3]))[0, 0], want) and learner.weights(np.array([5]))[0, 0] == 0
    x = language.weights_of(np.array([1.0, 3.0]), np.array([2.0, 1.0]))
    y = np.array([2.0, 1 + np.log(3)])
    assert np.allclose(x, y / np.sqrt(y @ y))


def test_temperature_sharpens_and_flattens():
    right = [(np.array([1.0, 0.0]), 0)] * 20
    assert language._temperature(right) < 0.2
    assert language._temperature([*right[:10], *[(np.array([4.0, 0.0]), y) for y in (0, 1) * 5]]) > 1.0


def test_token_store_tree_and_damage(spark, monkeypatch):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(k, f"document {k} of a store " * (k % 7)) for k in range(3000)]
    store = TokenStore(spark, Tables(spark, "test-tree").root).write(spark.createDataFrame(rows, "doc_id long, text string"), path, buckets=2)
    tree = store.table("ordered").where("seq < 0").groupBy("bucket", "seq").count().collect()
    assert {r["seq"] for r in tree} == {-1, -2} and store.verify()
    assert store.manifest().agg(F.sum("n_docs")).first()[0] == 3000
    whole = store.table("ordered").cache()
    for damaged in (whole.where("bucket = 0"), whole.where("not (bucket = 1 and seq = 17)"), whole.withColumn("n_tokens", F.when(F.col("seq") == 5, 1).otherwise(F.col("n_tokens")))):
        broken = TokenStore(spark, Tables(spark, "test-broken").root)
        damaged.write.parquet(f"{broken.path}/ordered")
        for name in ("parts", "root"):
            store.table(name).write.parquet(f"{broken.path}/{name}")
        assert not broken.verify()
        with pytest.raises(ValueError, match="don't agree"):
            broken.documents()
    lost = TokenStore(spark, Tables(spark, "test-lost").root)
    for name in ("ordered", "root"):
        store.table(name).write.parquet(f"{lost.path}/{name}")
    parts = store.table("parts")
    parts.where(F.col("kind") == "recipe").unionByName(parts.where("kind = 'chunk'").orderBy("root").offset(1)).write.parquet(f"{lost.path}/parts")
    with pytest.raises(Exception, match="chunks of a recipe are missing"):
        lost.documents().collect()


def test_short_items_are_found_inside_texts(spark):
    items = spark.createDataFrame([(1, "Blue whale song"), (2, "antidisestablishment"), (3, "")], "item_id long, text string")
    filler = " ".join(f"w{k}" for k in range(300))
    docs = spark.createDataFrame([(1, f"{filler} blue whale, song {filler}"), (2, f"{filler} blue song whale"), (3, f"an antidisestablishment {filler}"), (4, filler)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} >= {(1, 1), (3, 2)}
    assert not {r["doc_id"] for r in decontamination.leaks(docs, items).collect()} & {4}


def test_leaks_equal_alignment_of_all_pairs(spark):
    """Recall of edited copies against aligning every document with every item; nothing else is found."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([15, 25, 40])))) for k in range(30)]
    docs = []
    for k in range(240):
        w, rate = items[k % 30][1].split(), rng.choice([0.1, 0.15, 0.2, 0.25])
        edited = []
        for x in w:
            u = rng.random()
            edited += [rng.choice(vocabulary)] if u < rate / 2 else [] if u < 3 * rate / 4 else [x, rng.choice(vocabulary)] if u < rate else [x]
        docs.append((k, " ".join([*rng.choices(vocabulary, k=30), *edited, *rng.choices(vocabulary, k=30)])))
    number = {w: k for k, w in enumerate(vocabulary)}
    plain = lambda t: np.array([number[w] for w in t.split()])
    want = {(d, i) for d, t in docs for i, s in items if decontamination.align(plain(s), plain(t))[0] >= 0.5 * len(s.split())}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 150 and len(got) >= 0.97 * len(want)


def test_verdicts_by_the_hour(spark):
    entries = spark.createDataFrame([("ads", "x.com", "block", "2024-01-01 18:00:00")], "list string, pattern string, action string, dated string")
    rows = [(1, "http://x.com/", "2024-01-01 06:00:00"), (2, "http://x.com./", "2024-01-01 18:00:00"), (2, "http://x.com./", "2024-01-01 18:00:00"), (3, "http://x.com/", None)]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_filters.judged(captures, entries).collect()) == [(1, "keep"), (2, "block"), (2, "block"), (3, "keep")]


def words_of(text):
    return [w.lower() for w in (text or "").split()]


def passages_corpus(seed, trimmed):
    """Documents of lines with whole lines, edited lines and passages set into others, some without their ends if trimmed."""
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    new = lambda n: [f"x{next(fresh)}" for _ in range(n)]
    lines, passages, rows = [new(rng.choice([6, 12, 30, 70])) for _ in range(12)], [new(n) for n in (20, 49, 52, 60, 90, 140)], []
    for doc in rng.sample(range(1000), 40):
        text = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.35:
                line = list(rng.choice(lines))
                if rng.random() < 0.5:
                    line[rng.choice([0, -1, len(line) // 2])] = f"x{next(fresh)}"
                text.append(line)
            elif kind < 0.75:
                p = rng.choice(passages)
                a, b = (rng.randint(0, 8), len(p) - rng.randint(0, 8)) if trimmed else (0, len(p))
                text.append([*new(rng.randint(0, 40)), *p[a:b], *new(rng.randint(0, 40))])
            else:
                text.append(new(rng.randint(1, 60)))
        rows.append((doc, "\n".join(" ".join(x) for x in text)))
    return rows


def brute_lines(rows):
    """Places (doc, line) of the lines that go: not the first of their component."""
    lines = [(d, k, words_of(x)) for d, t in sorted(rows) for k, x in enumerate(t.split("\n"))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, _, w in lines]
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(d, k) for i, (d, k, _) in enumerate(lines) if find(i) != i}


@pytest.mark.parametrize("trimmed", [False, True])
def test_paragraph_removals_equal_brute_force(spark, trimmed):
    """Lines go as all pairs say; then repeats of 49 words go (to the ends they share with the first), and nothing that is no repeat of 15."""
    rows = passages_corpus(1, trimmed)
    out = {r["doc_id"]: r for r in paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute_lines(rows)
    left = {d: [w for k, x in enumerate(t.split("\n")) if (d, k) not in gone for w in words_of(x)] for d, t in rows}
    # of what the lines leave: the words of repeats of 49 words go, those of no repeat of 15 words stay
    must, may = {}, {}
    for least, marks in ((49, must), (15, may)):
        seen = set()
        for d in sorted(left):
            w, marked = left[d], set()
            for i in range(len(w) - least + 1):
                g = tuple(w[i : i + least])
                if g in seen:
                    marked |= set(range(i, i + least))
                seen.add(g)
            marks[d] = marked
    for d, w in left.items():
        kept = words_of(out[d]["text"])
        at, removed = 0, set()
        for i, x in enumerate(w):  # words of a document differ, so what is kept is found in order
            if at < len(kept) and kept[at] == x:
                at += 1
            else:
                removed.add(i)
        assert at == len(kept) and removed <= may[d]
        assert len(must[d] - removed) <= 16 * len(must[d]) / 49 if trimmed else must[d] <= removed
        assert out[d]["n_removed_words"] == len(words_of(dict(rows)[d])) - len(kept)


def test_no_passage_is_removed_everywhere(spark):
    new = lambda name, n: [f"{name}{k}" for k in range(n)]
    line, passage = new("a", 800), new("q", 80)
    rows = [(1, " ".join(line)), (2, " ".join([*line[:400], *passage, *line[400:]])), (3, " ".join([*new("b", 100), *passage, *new("c", 100)])), (4, " ".join([*new("d", 100), *passage]))]
    results = set()
    for parts in (1, 4, 7):
        out = paragraphs.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")).collect()
        results.add(tuple(sorted((r["doc_id"], r["text"], tuple(r["linked"])) for r in out)))
        assert set(passage) <= {w for r in out for w in words_of(r["text"])}
    assert len(results) == 1 and {d: of for d, _, of in next(iter(results))} == {1: (), 2: (1,), 3: (), 4: (3,)}


def test_texts_that_share_an_id_are_not_cut_by_each_other(spark):
    text = " ".join(f"w{k}" for k in range(90))
    other = " ".join(f"v{k}" for k in range(50)) + " " + text[:200]
    rows = [(1, text), (1, text), (1, other), (2, f"before {text} after"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = paragraphs.deduplicated(docs).collect()
    assert sorted(r["text"] for r in out if r["doc_id"] == 1) == sorted(t for d, t in rows if d == 1)
    assert [r["text"] for r in out if r["doc_id"] is None] == [text] and len(out) == 5
    kept = prefix_free.deduplicated(docs).collect()
    assert sorted(bytes(r["kept"]).decode() for r in kept if r["doc_id"] == 1) == sorted([text, text, other]) and len(kept) == 5
