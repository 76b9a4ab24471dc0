"""Periodic runs, top-k search and phrases against brute force."""

import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures_llm as X  # noqa: E402

from marketripple.llm import columnar_topk as K  # noqa: E402
from marketripple.llm import periodic_runs as P  # noqa: E402
from marketripple.llm import setm_phrases as S  # noqa: E402


def brute_runs(x, least=1):
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def periodic_sequences(n):
    """Small alphabets, Fibonacci words, repeated blocks, and periodic stretches that meet out of step."""
    r, fib = random.Random(5), ("a", "ab")
    while len(fib[1]) < 400:
        fib = fib[1], fib[1] + fib[0]
    for k in range(n):
        kind, size = k % 5, r.randint(1, 300)
        if kind == 0:
            yield [r.randint(0, 1) for _ in range(size)]
        elif kind == 1:
            yield [ord(c) for c in fib[1][:size]]
        elif kind == 2:
            u = [r.randint(0, 2) for _ in range(r.randint(1, 60))]
            yield u * r.randint(1, 6) + [r.randint(0, 2) for _ in range(r.randint(0, 10))] + u * r.randint(1, 4)
        else:
            out = []
            while len(out) < size:
                u = [r.randint(0, 1) for _ in range(r.randint(1, 4))]
                for _ in range(r.randint(1, 4)):
                    out += (u * 60)[r.randint(0, 3):][:r.randint(1, 80)]
            yield out * r.randint(1, 2)


def test_runs_equal_brute_force():
    for x in periodic_sequences(600):
        assert sorted(map(tuple, P.find_runs(np.array(x)).tolist())) == brute_runs(x), x


def test_each_part_of_the_search_is_needed(monkeypatch):
    xs = list(periodic_sequences(200))
    whole = sum(len(P.find_runs(np.array(x))) for x in xs)
    none = lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for name in ("_equal_contexts", "_joined_regions"):
        with monkeypatch.context() as m:
            m.setattr(P, name, none)
            assert sum(len(P.find_runs(np.array(x))) for x in xs) < whole


def test_synchronising_set_depends_on_context_only():
    r = random.Random(3)
    x = np.array([r.randint(0, 1) for _ in range(3000)])
    w, runs = P.Windows(x, len(x)), P.find_runs(x)
    for t in (4, 8, 16):
        chosen = np.zeros(len(x), bool)
        chosen[P._sync(w.levels[t.bit_length() - 1], t, runs)] = True
        kinds = {}
        for i in range(len(x) - 2 * t + 1):
            assert kinds.setdefault(tuple(x[i:i + 2 * t]), chosen[i]) == chosen[i]


def described(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = set()
    for s, e, q in runs:
        gone |= set(range(s + q, e))
    best = min(((s - e, s, q) for s, e, q in runs), default=None)
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], math.floor(1000 * -best[0] / best[2]))
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(runs, key=lambda r: (r[0], r[2])))
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (key, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_documents_with_runs(spark, monkeypatch):
    r = random.Random(9)
    texts = [t for t in X.awkward() if t is None or len(t) < 20_000] + ["la " * 40, " ".join(map(str, "ab" * 20)), X.prose(30, 1) + " " + X.prose(9, 2) * 1 + " " + " ".join([X.prose(9, 2)] * 4)]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(1, 200))) for _ in range(60)] + [X.prose(r.randint(1, 150), k) for k in range(120)]
    ids = [*range(len(texts) - 2), None, 4]
    want = [described(i, t) for i, t in zip(ids, texts)]
    assert sum(w[1] > 0 for w in want) > 40
    for size in (P.SEQUENCE_BYTES, 50):
        monkeypatch.setattr(P, "SEQUENCE_BYTES", size)
        made = P.periodic_runs(X.documents(spark, texts, ids=ids, clash=True))
        assert made.columns[-2:] == ["runs", "collapsed"]
        assert sorted(map(tuple, made.drop("runs", "collapsed").collect()), key=repr) == sorted(want, key=repr)
    assert P.periodic_runs(X.documents(spark, [])).count() == 0
    plain = P.periodic_runs(X.documents(spark, ["x y " * 30]), prepare=lambda words, key: words).first()
    assert (plain.runs, plain.collapsed) == ("0,60,2\n", "x y")


def test_long_text_with_a_long_period(spark):
    unit = X.prose(20_000, 7)
    row = P.periodic_runs(X.documents(spark, [f"{unit} {unit} {unit} end"]), prepare=lambda words, key: words).first()
    assert (row.n_runs >= 1, row.start, row.length, row.period) == (True, 0, 60_000, 20_000) and row.collapsed == unit + " end"


VEC = "vec_id bigint, embedding array<float>, label int, row string, tile string, v string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z", "w") for i, v in rows], VEC)


def brute_top(rows, k, every):
    out, ok = [], [(i, [math.floor(256 * x) for x in np.array(v, np.float32).tolist()]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for a, (i, v) in enumerate(ok):
        if i is None or i % every:
            continue
        s = [(-max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(v, w)))), j is None, j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)]
        out += [(i, rank, j, -x) for rank, (x, _, j) in enumerate(sorted(s, key=lambda t: (t[0], t[1], t[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile,span", [(8192, 64), (7, 3), (40, 1)])
def test_top_k_equals_brute_force(spark, tile, span):
    r = random.Random(2)
    base = [[r.gauss(0, 0.2) for _ in range(20)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in base[i % 6]]) for i in range(160)]
    rows += [(200 + i, base[0]) for i in range(12)] + [(0, base[0]), (0, base[0]), (None, base[1]), (5, None), (10, [None] * 20), (20, [float("nan")] * 20), (30, [float("inf")] * 20)]
    rows += [(40, [0.0] * 20), (50, []), (51, []), (60, [1.0, 2.0]), (61, [3.0, -1.0]), (62, [1.0, 2.0])]
    got = sorted(map(tuple, K.top_k(vectors(spark, rows), every=10, tile=tile, span=span, block=3).collect()), key=repr)
    assert got == brute_top(rows, 5, 10)
    assert K.top_k(vectors(spark, [])).count() == 0
    assert K.top_k(vectors(spark, [(50, [1.0])])).count() == 0


def test_top_k_of_large_components(spark):
    rows = [(i, [(-1) ** i * 1e30, float(i), 2.0 ** (i % 40)]) for i in range(30)]
    assert sorted(map(tuple, K.top_k(vectors(spark, rows), every=10).collect()), key=repr) == brute_top(
        [(i, [max(-(2.0 ** 63), min(2.0 ** 63, 256 * x)) / 256 for x in np.array(v, np.float32).tolist()]) for i, v in rows], 5, 10)


def test_bounds_discard():
    r = np.random.default_rng(1)
    v = np.floor(256 * np.concatenate((r.normal(0, 0.02, (4000, 64)), np.repeat(r.normal(0, 0.3, (1, 64)), 20, axis=0) + r.normal(0, 0.02, (20, 64))))).astype(np.int64)
    tile = K.Tile(v)
    list(K.search(tile, v[-5:], np.arange(4015, 4020), np.full(5, -np.inf), 5))
    assert tile.rows_met < 5 * len(v) * len(tile.blocks) / 2


def brute_phrases(rows, longest, least, inside, top):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f = {}
    for lang, text in rows:
        for piece in __import__("re").split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(table)):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            c = f.setdefault(lang or "und", Counter())
            c.update(tuple(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        frequent = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        rows = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * v >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, v in frequent.items()):
                continue
            score, k, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, left, right, n, score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i, *x) for i, x in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,bits,row_bytes", [(3, 1 << 26, 8_000_000), (5, 1 << 10, 300), (2, 64, 100)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, bits, row_bytes):
    monkeypatch.setattr(S, "ROW_BYTES", row_bytes)
    monkeypatch.setattr(S, "HELD_BYTES", 4 * row_bytes)
    r = random.Random(4)
    vocabulary = X.WORDS[:14] + ["Ärger", "naïve", "\x01", "\x85", "Ka", "KA"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r", "\x0b;"]) for _ in range(r.randint(0, 80)))) for _ in range(120)]
    rows += [("en", None), (None, ""), ("fr", " \t.,"), ("fr", "a a a a a a a a a a a a a a. a"), ("es", "x y " * 500)] + [("en", "kara lomi nure. Sate vora")] * 15
    docs = spark.createDataFrame([(i, t, lang, "s", "1", "2", "3", "4") for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, w1 string, f string, a string, n string, word string")
    got = S.collocations(docs, longest=longest, top=40, filter_bits=bits)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, longest, 10, 50, 40)
    assert S.collocations(docs.limit(0)).count() == 0


def test_words_with_one_hash_take_another_seed(spark, monkeypatch):
    real = S._occurrences

    def equal_at_seed_0(seed):
        fn = real(seed)

        def run(batches):
            for b in fn(batches):
                yield b if seed else b.set_column(3, "hashes", pa.array([[7] * len(x) for x in b.column(3).to_pylist()], pa.list_(pa.int64())))
        return run

    monkeypatch.setattr(S, "_occurrences", equal_at_seed_0)
    docs = spark.createDataFrame([("en", "one two three")] * 12, "lang string, text string").repartition(1)
    assert [r.phrase for r in S.collocations(docs).collect()] == ["one two three"]  # the pairs lie inside it
    with pytest.raises(RuntimeError):
        S.occurrences(docs, attempts=1)
