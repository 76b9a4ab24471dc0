"""Substring dedup, chunk fingerprints, lattice hashing."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures_llm as X  # noqa: E402

from marketripple.llm import chunk_fingerprints as C, cover_dedup as D, lattice_neardup as L  # noqa: E402


def plain_removal(rows):
    """(doc_id, text) to {doc_id: (n_words, n_removed, sha)} by looking at every window."""
    first = {}
    cut = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 49):
            first.setdefault(tuple(cut[i][k:k + 50]), i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k:k + 50])] < i:
                gone |= set(range(k, k + 50))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left).hexdigest())
    return out


def test_cover_meets_at_every_shift():
    assert {(a - b) % D.PERIOD for a in D.COVER for b in D.COVER} == set(range(D.PERIOD))


@pytest.mark.parametrize("hot", [100_000, 3])
def test_removal_matches_brute_force(spark, hot):
    r = random.Random(5)
    shared = [X.prose(n, 50 + n).split() for n in (49, 50, 51, 60, 130)]
    rows = list(enumerate([t for t in X.awkward() if t is None or len(t) < 40_000]))
    for i in range(60):
        words = X.prose(r.randint(0, 90), i).split()
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a, b = sorted((r.randint(0, len(p)), r.randint(0, len(p)))) if r.random() < 0.3 else (0, len(p))
            at = r.randint(0, len(words))
            words[at:at] = p[a:b]
        rows.append((100 + r.randint(0, 10_000), " ".join(words)))
    rows = list(dict(rows).items())
    docs = X.documents(spark, [t for _, t in rows], ids=[i for i, _ in rows], clash=True)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in D.remove_repeats(docs, hot).collect()}
    assert got == plain_removal(rows) and sum(v[1] for v in got.values()) > 500


def test_removal_awkward(spark):
    long = X.prose(60_000, 1)
    docs = X.documents(spark, [long, long, "x " + long, long, None], ids=[2, 1, 3, None, 9])
    docs = docs.unionByName(docs.where("doc_id = 3"))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in D.remove_repeats(docs).collect())
    assert got == [("1", 60_000, 0), ("2", 60_000, 60_000), ("3", 60_001, 60_000), ("3", 60_001, 60_000), ("9", 0, 0), ("None", 60_000, 0)]
    assert D.remove_repeats(docs.where("false")).count() == 0


def plain_ends(data):
    ends, start = [], 0
    while start < len(data):
        end = min(start + C.MOST, len(data))
        for e in range(start + C.LEAST, min(start + C.MOST, len(data) + 1)):
            h = 0
            for b in data[max(0, e - C.WINDOW):e]:
                h = ((h << 1) + int(C.GEAR[b])) & 0xFFFFFFFF
            mask = int(C.STRICT) if e < start + C.NORMAL else int(C.LOOSE)
            if h & mask == 0:
                end = e
                break
        ends.append(end)
        start = end
    return ends


def test_chunks_match_brute_force(monkeypatch):
    texts = [t or "" for t in X.awkward()[:9]] + [X.prose(300, 2), "a" * 1000, "é" * 300]
    for t in texts:
        assert C.chunk_ends(t.encode()) == plain_ends(t.encode())
    monkeypatch.setattr(C, "BLOCK", 70)
    for t in texts:
        assert C.chunk_ends(t.encode()) == plain_ends(t.encode())


def test_fingerprints_match_brute_force(spark):
    texts = X.awkward() + [X.prose(50 + i, i) for i in range(40)]
    ids = [(i * 7919) % 1009 for i in range(len(texts))]
    docs = X.documents(spark, texts, ids=ids, clash=True)
    got = {r.doc_id: r for r in C.compare_with_next(docs).collect()}
    order = sorted(zip(ids, texts), reverse=True, key=lambda r: r[0])
    assert len(got) == len(texts)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after, g = t or "", after or "", got[i]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.fingerprint == C.fingerprint(t) and g.edited_fingerprint == C.fingerprint(edited)
        a = C.split_records(g.fingerprint)
        assert g.near_edited == C.containment(a, C.split_records(g.edited_fingerprint)) and g.near_next == C.containment(a, C.split_records(C.fingerprint(after)))
    some = [got[i] for i, t in zip(ids, texts) if t and 400 < len(t) < 2000]
    assert np.mean([g.near_edited for g in some]) > 0.55 and np.mean([g.near_next for g in some]) < 0.1


def test_fingerprints_awkward_ids(spark):
    assert C.compare_with_next(X.documents(spark, [])).count() == 0
    one = C.compare_with_next(X.documents(spark, ["abc"])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    docs = X.documents(spark, ["b" * 30, "a" * 30, "c" * 30, "d" * 30], ids=[5, 5, None, None])
    got = sorted((str(r.doc_id), r.edited_sha256) for r in C.compare_with_next(docs).collect())
    chain = ["a" * 30, "b" * 30, "c" * 30, "d" * 30]
    want = [(i, hashlib.sha256((t[:20] + n[:10]).encode()).hexdigest()) for i, t, n in zip(["5", "5", "None", "None"], chain, chain[1:] + chain[:1])]
    assert got == sorted(want)
    assert C.compare_with_next(docs.where("doc_id is null")).count() == 2


def vectors(seed=3, dim=64):
    r = np.random.default_rng(seed)
    rows = []
    for group, n in ((0, 40), (1, 12), (2, 5), (3, 3)):
        centre = r.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            noise = r.normal(size=dim)
            v = centre + 0.11 * noise / np.linalg.norm(noise)
            rows.append((v * r.uniform(0.1, 9)).astype(np.float32).astype(float).tolist())
    rows += [r.normal(size=dim).astype(np.float32).astype(float).tolist() for _ in range(150)]
    rows += [rows[0]] * 30 + [(np.array(rows[1]) * 2).tolist()]
    out = [(i, v, int(i % 2)) for i, v in enumerate(rows)]
    n = len(out)
    return out + [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * dim, 1), (n + 3, [float("nan")] + [1.0] * (dim - 1), 1), (n + 4, [None] + [1.0] * (dim - 1), 1),
                  (n + 5, [float("inf")] * dim, 1), (n + 6, rows[0], None), (n + 7, [1.0, 0.0], 1), (n + 8, [2.0, 0.0], 1)]


def plain_links(rows):
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = rows[a], rows[b]
            if a < b and x[2] == y[2] and len(x[1]) == len(y[1]) and np.dot(x[1], y[1]) / np.linalg.norm(x[1]) / np.linalg.norm(y[1]) >= 0.98:
                links[a].add(b), links[b].add(a)
    return links


@pytest.mark.parametrize("tile", [1024, 6])
def test_lattice_finds_links(spark, tile):
    rows = vectors()
    want = plain_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "vec_id as cid", "label as t", "label as cell", "label as home")
    got = {r.vec_id: r for r in L.near_duplicates(df, tile=tile).collect()}
    assert len(got) == len(rows)
    found, all_of = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert 0.98 * all_of <= found <= all_of and all(got[i].n_links <= len(want[i]) for i in want)
    low = {i: i for i in want}
    for _ in want:
        for i, js in want.items():
            low[i] = min([low[i], *(low[j] for j in js)])
    assert {i: r.component_id for i, r in got.items()} == low and all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_lattice_awkward(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert L.near_duplicates(df.where("false")).count() == 0
    v = [1.0] * 8
    got = L.near_duplicates(spark.createDataFrame([(None, v, 1), (4, v, 1), (4, v, 1), (2, v, 2)], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in got) == [("2", 0, 2, True), ("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]


def test_e8_decoder():
    r = np.random.default_rng(1)
    y = r.normal(size=(300, 8)) * 2
    p = L.decode(y)
    q = (p * 2).astype(int)
    assert (((q % 2 == 0).all(axis=1)) | ((q % 2 == 1).all(axis=1))).all() and (p.sum(axis=1) % 2 == 0).all()
    assert len(L.ROOTS) == 240 and np.allclose((L.ROOTS ** 2).sum(axis=1), 2)
    d = ((y - p) ** 2).sum(axis=1)
    assert (d[:, None] <= ((y[:, None] - p[:, None] - L.ROOTS) ** 2).sum(axis=2) + 1e-9).all()
