"""SimHash near-duplicates, byte-level BPE, token counts."""

import hashlib
import os
import random
import sys
import uuid

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken
import xxhash

sys.path.insert(0, os.path.dirname(__file__))
import fixtures_llm as X  # noqa: E402

from marketripple.llm import byte_bpe, simhash_pivots as S, token_counts  # noqa: E402
from marketripple.session import scratch_dir  # noqa: E402

BLANK = b" \t\n\x0b\x0c\r"


def plain_fingerprint(text):
    words, cur = [], b""
    for b in (text or "").encode():
        c = bytes([b + 32 if 65 <= b <= 90 else b])
        if b in BLANK:
            words, cur = words + [cur] * bool(cur), b""
        else:
            cur += c
    words += [cur] * bool(cur)
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def reach(pairs, nodes):
    low = {n: n for n in nodes}
    while True:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                moved = True
        if not moved:
            return low


def components(fps):
    """index -> smallest index reachable."""
    n = len(fps)
    return reach([(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(n))


def test_fingerprint_is_plain():
    for t in [*X.awkward()[:9], "A b C", "a b", X.prose(500, 3)]:
        assert int.from_bytes(S.fingerprint(t), "big") == plain_fingerprint(t)


def test_near_duplicates_match_brute_force(spark):
    base = X.prose(400, 7)
    texts = X.awkward() + [base] + [" ".join(w if i != k * 37 % 400 else "changed" for i, w in enumerate(base.split())) for k in range(12)]
    got = {r.doc_id: r for r in S.near_duplicates(X.documents(spark, texts, clash=True)).collect()}
    fps = [plain_fingerprint(t) for t in texts[:9]] + [int.from_bytes(S.fingerprint(t), "big") for t in texts[9:]]
    want = components(fps)
    assert {i: (f"{fps[i]:016x}", want[i]) for i in want} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
    assert len(set(want.values())) < len(texts)


@pytest.mark.parametrize("most", [4096, 3])
def test_links_lose_nothing(spark, most):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:25]:
        for _ in range(8):
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps | {0, 1, 7, (1 << 64) - 1})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = S.fingerprint_links(spark.createDataFrame(signed, "fp bigint"), most=most).collect()
    at = {s[0]: i for i, s in enumerate(signed)}
    assert all(((fps[at[a]] ^ fps[at[b]]).bit_count() <= 3) for a, b in links)
    assert reach([(at[a], at[b]) for a, b in links], range(len(fps))) == components(fps)


def test_forest_spares_pairs():
    fp = np.array([1 << i for i in range(60)], np.uint64)
    assert len(S.forest(fp, S.distances(fp), 3)[0]) == 59


def test_references_spare_verification(monkeypatch):
    r = np.random.default_rng(4)
    fp = r.integers(0, 1 << 63, 400).astype(np.uint64)
    fp = np.unique(np.concatenate((fp, fp[:50] ^ np.uint64(5))))
    a, b, verified = S.forest(fp, S.distances(fp), 3)
    monkeypatch.setattr(S, "survivors", lambda d, i, left, most: np.arange(len(left)))
    all_of = S.forest(fp, S.distances(fp), 3)
    assert len(a) == len(all_of[0]) >= 50 and verified * 20 < all_of[2]


def test_table_bounds_distances():
    r = np.random.default_rng(5)
    x, y = r.integers(0, 1 << 63, (2, 2000)).astype(np.uint64)
    d = S.distances(np.concatenate((x, y)))
    assert (np.abs(d[:2000] - d[2000:]).max(axis=1) <= np.bitwise_count(x ^ y)).all()


def test_empty_tables(spark):
    none = X.documents(spark, [])
    assert S.near_duplicates(none).count() == 0
    assert byte_bpe.digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def own():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def strings():
    r = random.Random(4)
    pool = "ab 1\n\t .,'sé́漢\U0001f600  ß٣ⅷ"
    return [t or "" for t in X.awkward()] + ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300)] + ["<|endoftext|> it's  we'LL\n\n x"] + [
        f"a{c}1{c} {c}{c}  {c}!" for c in map(chr, range(0, 0x3000, 7)) if not 0xD800 <= ord(c) < 0xE000]


def test_bpe_equals_tiktoken(bpe, own):
    for t, w in zip(strings(), bpe.encode_words(strings())):
        ids = np.frombuffer(w, "<u4").tolist()
        assert ids == own.encode_ordinary(t) and bpe.decode_bytes(ids) == t.encode()


def test_blocks_do_not_change_ids(bpe, own, monkeypatch):
    text = X.prose(3000, 8) + "   " + "z" * 500 + " \n tail"
    monkeypatch.setattr(byte_bpe, "BLOCK", 50)
    assert np.frombuffer(bpe.encode_words([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_offsets_and_split_characters(bpe):
    text = "aé 漢\U0001f600 end"
    ids, spans = bpe.encode(text)
    assert bpe.decode(ids) == text and len(ids) == len(spans)
    for i, (a, b) in enumerate(spans):
        assert bpe.decode_bytes(ids[i:i + 1]) in text[a:b].encode()
    k = next(i for i, (a, b) in enumerate(spans) if text[a:b].strip() == "\U0001f600")
    assert "�" in bpe.decode(ids[:k + 1]) or bpe.decode(ids[:k + 1]) == text[: spans[k][1]]


def test_bpe_tables(spark, own):
    docs = X.documents(spark, X.awkward(), clash=True)
    got = {r.doc_id: r for r in byte_bpe.digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id"]).collect()}
    for i, t in enumerate(X.awkward()):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    some = docs.where("doc_id < 9")
    full = byte_bpe.encode(some, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id", "text"])
    back = byte_bpe.decode(full, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ["doc_id", "text"]).collect()
    assert all(r.decoded_text == (r.text or "") for r in back) and len(back) == 9


def test_token_counts_equal_library(spark):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = X.awkward() + strings()[-450:] + ["a  b", " a b ", "<|startoftext|>x<|ENDOFTEXT|> <|endoftext|>", "İstanbul ΣΑΣ ﬁ"]
    cache = f"{scratch_dir(spark)}/test-cache-{uuid.uuid4().hex}"
    docs = X.documents(spark, texts, ids=[None if i == 4 else i for i in range(len(texts))], clash=True)
    docs = docs.unionByName(docs.where("doc_id < 3"))
    first = sorted([tuple(r)[:4] for r in token_counts.count_tokens(docs, path, cache).where("not cached").collect()], key=str)
    want = []
    for i, t in [*enumerate(texts), *enumerate(texts[:3])]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((None if i == 4 else i, len((t or "").encode()), n, n > 2048))
    assert first == sorted(want, key=str)
    stored = spark.createDataFrame(spark.read.parquet(cache).collect(), token_counts._CACHE)
    assert stored.count() == stored.select("digest").distinct().count() < len(texts)
    # a warm cache: nothing new is encoded, and a new text alone is appended
    more = docs.unionByName(X.documents(spark, ["brand new"], ids=[10_000], clash=True))
    made = token_counts.count_tokens(more, path, cache).collect()
    assert [r.doc_id for r in made if not r.cached] == [10_000]
    again = sorted([tuple(r)[:4] for r in made], key=str)
    assert [r for r in again if r[0] != 10_000] == first and len(again) == len(first) + 1
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # counts come out of the store: another one there is another one here
    version = token_counts.tokenizer_version(path)
    other = f"{scratch_dir(spark)}/test-cache-{uuid.uuid4().hex}"
    spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 7).unionByName(spark.read.parquet(cache).withColumn("version", F.lit("older"))).write.parquet(other)
    changed = sorted([(r.doc_id, r.n_bytes, r.n_tokens - 7, r.cached) for r in token_counts.count_tokens(docs, path, other).collect()], key=str)
    assert changed == sorted([(*r[:3], True) for r in first], key=str) and spark.read.parquet(other).where(F.col("version") == version).count() == stored.count() + 1


def test_every_simple_character_counts_as_library():
    c = token_counts.TokenCounter(P.path("word_bpe_49k.json"))
    texts = [f"a{x}1{x} {x}{x}B{x}'s" for x in map(chr, range(0x300))]
    assert c.counts(texts) == c._library(texts)
