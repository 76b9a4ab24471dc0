"""URL filter, quality classifier, source mixing, secret scan."""

import hashlib
import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures_llm as X  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from marketripple.llm import quality_mil as Q, secret_markov as K, source_mixing as M, url_markov as U  # noqa: E402
from marketripple.llm.queries import RULES  # noqa: E402

SF = "/root/testdata/sf0.01"
URLS = ["http://a.example.org/en/12", "https://example.org/es/x", "http://x.EXAMPLE.org/en/1?q=/z", "http://shop.com/fr/1#t", "https://shop.com/de/é", "http://com/fr/", "http://org",
        "http://org/", "http://myorg/a", "nothing", None, "", "://", "ftp://h.net?x/y", "http://b.com/en/://c.org/", "http://free.net/fr/", "HTTP://B.COM/fr", "http://b.com/fr/1", "a b://c d.org/e f"]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), r, v) for r, v in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def plain_scores(urls):
    """Witten-Bell models by direct counting."""
    def symbols(u):
        t = u.split("://", 1)[1] if "://" in u else u
        return "".join(c.lower() if "A" <= c <= "Z" else c if " " <= c <= "~" else U.OTHER for c in t)
    counts = {v: [defaultdict(Counter) for _ in range(3)] for v in ("allow", "block")}
    for u in set(urls):
        v = plain_rule(u)[3]
        s = U.START * 2 + symbols(u)
        for i in range(2, len(s)):
            for k in range(3):
                if v:
                    counts[v][k][s[i - k:i]][s[i]] += 1

    def p(v, s, i, k):
        q = p(v, s, i, k - 1) if k else 1 / U.ALPHABET
        c = counts[v][k][s[i - k:i]]
        n, t = sum(c.values()), len(c)
        return (c[s[i]] + t * q) / (n + t) if n else q
    out = {}
    for u in set(urls):
        s = U.START * 2 + symbols(u)
        d = [math.log(p("allow", s, i, 2)) - math.log(p("block", s, i, 2)) for i in range(2, len(s))]
        out[u] = sum(d) / len(d) if d else 0.0
    return out


def test_urls_match_brute_force(spark):
    r = random.Random(3)
    urls = URLS + [f"http://{r.choice(['ab', 'cd', 'www.ef'])}.{r.choice(['com', 'org', 'net'])}/{r.choice(['fr', 'de', 'en'])}/{r.randint(1, 99)}" for _ in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url as gram", "url as score", "page_id as symbols")
    pages = pages.unionByName(pages.where("page_id < 3"))
    got = U.filter_urls(pages, RULES).collect()
    assert len(got) == len(urls) + 3
    scores = plain_scores([u for u in urls if u])
    ruled = {u: plain_rule(u)[3] for u in scores}
    for g in got:
        u = urls[g.page_id]
        host, path, rule, verdict = plain_rule(u)
        assert (g.host, g.path, g.rule) == (host, path, rule), u
        assert math.isclose(g.score, scores.get(u, 0.0), abs_tol=1e-9), u
        assert g.verdict == verdict if verdict else g.verdict in ("allow", "block")
    free = [(g.score, g.verdict) for g in got if g.rule is None]
    assert min([s for s, v in free if v == "allow"], default=9) > max([s for s, v in free if v == "block"], default=-9)
    mean = lambda v: np.mean([s for u, s in scores.items() if ruled[u] == v])
    assert mean("allow") > 0 > mean("block")


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (None, None)], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in U.filter_urls(pages, RULES).collect()} == {(1, "allow"), (None, "allow")}
    assert U.filter_urls(pages.where("false"), RULES).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels.unionByName(labels))
    got = Q.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(Q.held_out()).select("quality", "predicted", "score").collect()
    assert len(got) > 50
    for y in (0, 1):
        mine = [r.predicted == y for r in got if r.quality == y]
        assert np.mean(mine) > 0.97


def test_held_out_fold_is_crc32(spark):
    import zlib
    got = spark.range(300).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_attention_learns_one_bad_passage():
    r = random.Random(0)
    texts, labels = [], []
    for k in range(240):
        words = X.prose(64 * r.randint(1, 6), k).split()
        bad = r.random() < 0.5
        if bad:
            at = 64 * r.randrange(len(words) // 64)
            words[at:at + 64] = [w[::-1] for w in words[at:at + 64]]  # the same letters in another order
        texts.append(" ".join(words)), labels.append(int(not bad))
    bags = [Q.Passages(t) for t in texts]
    m = Q.GatedAttention().fit(bags[:180], labels[:180])
    assert np.mean((m.score(bags[180:]) > 0.5) == np.array(labels[180:])) > 0.9


def small_model():
    m = Q.GatedAttention(hidden=5, gate=3, seed=2)
    m.p["be"], m.p["bv"], m.p["bu"] = (m.random.normal(size=m.p[k].shape) for k in ("be", "bv", "bu"))
    return m


def plain_score(m, text):
    """The score by loops over words and characters."""
    p, words = m.p, (text or "").encode().split()
    cuts = list(range(0, len(words), 64)) or [0]
    if len(cuts) > 1 and len(words) - cuts[-1] < 16:
        cuts.pop()
    h = []
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        data, follow = b"".join(w + b" " for w in words[a:b]), b"".join(w + b" " for w in words[b:b + 2])[:2]
        data += (follow + b"  ")[:2]
        grams = [int(Q._bucket(np.array([data[i] | data[i + 1] << 8 | data[i + 2] << 16], np.uint64))[0]) for i in range(len(data) - 2)]
        marks = [int(Q._bucket(np.array([sum((c + 1) * pow(0x100000001B3, min(i, 4095) + 1, 2 ** 64) for i, c in enumerate(w + b" ")) % 2 ** 64], np.uint64))[0]) for w in words[a:b]]
        content = sum(p["E"][g] for g in grams) / max(1, len(grams)) + sum(p["E"][g] for g in marks) / max(1, len(marks)) if words else np.zeros(Q.EMBED)
        form = (Q.Passages(" ".join(w.decode() for w in words[a:b])).form[0] - m.mean) / m.scale
        h.append(np.tanh(np.concatenate((form, content)) @ p["We"] + p["be"]))
    e = [math.exp(float((np.tanh(x @ p["V"] + p["bv"]) / (1 + np.exp(-(x @ p["U"] + p["bu"])))) @ p["a"])) for x in h]
    z = sum(w * x for w, x in zip(e, h)) / sum(e)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


def test_score_equals_brute_force(monkeypatch):
    m, texts = small_model(), [X.prose(n, n) for n in (1, 63, 64, 79, 80, 200, 500)] + ["", None, "a", "naïve café \U0001f600", "x" * 5000]
    want = [plain_score(m, t) for t in texts]
    assert np.allclose(m.score([Q.Passages(t) for t in texts]), want, atol=1e-6)
    monkeypatch.setattr(Q, "BLOCK", 50)
    assert np.allclose([m.score([Q.Passages(t)])[0] for t in texts], want, atol=1e-6)


def test_gradients_equal_differences():
    m, bags, y = small_model(), [Q.Passages(X.prose(n, n)) for n in (40, 150, 300)], np.array([0, 1, 1])
    loss = lambda: -sum(math.log(s if t else 1 - s) for s, t in zip(m.score(bags), y))
    f = m._forward(*m._inputs(bags))
    g = m._gradients(bags, f, f["y"] - y)
    for name, p in m.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), p.shape)
        old, step = p[at], 1e-5
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert math.isclose((up - down) / (2 * step), g[name][at], rel_tol=1e-3), name


def test_score_reads_content(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.train(docs, labels)
    text = X.prose(300, 5)
    other = text.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm"))
    a, b = Q.Passages(text), Q.Passages(other)
    assert np.allclose(a.form, b.form) and model.score([a])[0] != model.score([b])[0]


def test_quality_awkward(spark):
    docs = X.documents(spark, X.awkward(), clash=True)
    labels = spark.createDataFrame([(0, 1), (None, 0), (77, 0), (5, None)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = Q.score(docs.drop("score"), model, ["doc_id"]).collect()
    assert len(got) == len(X.awkward()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert Q.keep_good(docs, model).columns == docs.columns
    assert Q.train(docs, labels.where("false")).score([Q.Passages("a")])[0] == 0.5
    assert Q.score(docs.where("false"), model, ["doc_id"]).count() == 0


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > 2 * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mix_follows_brute_force(spark):
    r = random.Random(1)
    texts = X.awkward() + [X.prose(r.randint(1, 60), i) for i in range(300)]
    sources = [r.choice(["b", "a", "é", "\U0001f600", "￿", None, "hot", "hot", "hot"]) for _ in texts]
    docs = X.documents(spark, texts, sources=sources, clash=True)
    got = {x.doc_id: x for x in M.mix(docs).collect()}
    size = [len((t or "").encode().split()) for t in texts]
    sums = Counter()
    for s, n in zip(sources, size):
        sums[s] += n
    want = plain_targets(dict(sums))
    by = defaultdict(list)
    for i, s in enumerate(sources):
        assert got[i].size == size[i] and got[i].source_size == sums[s] and math.isclose(got[i].target, want[s], rel_tol=1e-9)
        w = max(0.1, len([c for c in texts[i] if c not in M.SYMBOLS]) / len(texts[i])) if texts[i] else 0.1
        u = (int(hashlib.md5(f"{i}:{texts[i] or ''}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        by[s].append((-math.log(u) / w, i))
    for s, rows in by.items():
        epochs = int(want[s] // sums[s]) if sums[s] else 0
        left = math.floor(want[s] - epochs * sums[s])
        for _, i in sorted(rows):
            part = max(0, min(size[i], left))
            left -= size[i]
            assert got[i].taken == epochs * size[i] + part
        assert abs(sum(got[i].taken for _, i in rows) - want[s]) <= 1


def test_mix_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(M.MIX_SQL).fetchall()}
    for r in M.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert r[1:3] == want[r[0]][0:2] and math.isclose(r[3], want[r[0]][2], rel_tol=1e-12) and r[4] == want[r[0]][3]


def test_mix_empty_and_copies(spark):
    assert M.mix(X.documents(spark, [])).count() == 0
    assert [r.taken for r in M.mix(X.documents(spark, ["", None], sources=["a", "b"])).collect()] == [0, 0]
    docs = X.documents(spark, [X.prose(10, i) for i in range(40)], sources=["a"] * 30 + ["b"] * 10, clash=True)
    n = {r.doc_id: math.ceil(r.taken / r.size) for r in M.mix(docs).collect()}
    out = M.copies(docs)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: k for i, k in n.items() if k})


def test_mix_of_equal_rows_and_rows_without_id(spark):
    """Rows without id, with one id, or equal in all: the mix meets its target, and so do the copies."""
    texts = [X.prose(10, i) for i in range(300)] + [X.prose(12, 999)] * 2000
    docs = X.documents(spark, texts, sources=["a"] * 1700 + ["b"] * 600, clash=True)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.when(F.col("doc_id") < 300, F.col("doc_id")))).cache()
    for options in ({}, {"weights": (1, 5), "share": 0.9}):
        got = M.mix(docs, chunk=64, **options).collect()
        assert options or Counter(map(tuple, got)) == Counter(map(tuple, M.mix(docs).collect()))
        assert len(got) == 2300 and all(0 <= r.taken <= 2 * r.size for r in got)
        by = {}
        for r in got:
            by.setdefault((r.source_size, r.target), []).append(r.taken)
        assert all(abs(sum(v) - target) < 1 for (_, target), v in by.items())
        want = sum(math.ceil(r.taken / r.size) for r in got)
        out = M.copies(docs, **options).collect()
        assert len(out) == want
        words = Counter()
        for r in out:
            words[r.source] += len(r.text.split())
        assert all(-1 < words[s] - t < 13 for s, t in zip("ab", [t for _, t in sorted(by, reverse=True)]))


def plain_base(text):
    spans = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return ",".join(f"{K.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SECRETS = ['é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "password:short secret:token:abcdef apikey=x API_KEY ==abcdefg", "AKIA" + "Z" * 15 + " AKIA" + "Q2" * 10, "ſecret=abcdefgh toKen=abcdefgh",
           "key q8Zr4TnV1xPw7LbD0sKj3MfY6uGc here " + "f" * 30, "a" * 24, "passwd='" + "x" * 500]


def test_base_spans_match_brute_force():
    r = random.Random(6)
    pool = ["token", "Secret", "api_key", "=", ":", '"', " ", "abcdef0123456789", "AKIA", "Z9Z9Z9Z9Z9Z9Z9Z9", "é", ".", "x-y", "\n"]
    for t in SECRETS + X.awkward() + ["".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(2000)]:
        assert K.joined(K.base_spans(t or "")) == plain_base(t)


def test_model_finds_random_strings(spark):
    texts = SECRETS + X.awkward()[:9] + [X.prose(400, i) for i in range(30)] + [f"{X.prose(9, i)} {'Longer' * 5}Identifier_{'name' * 4}" for i in range(30)]
    docs = X.documents(spark, texts, clash=True)
    tables = K.train(docs)
    got = {r.doc_id: r for r in K.scan(docs.drop("spans"), tables, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        base = plain_base(t)
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[i].n_hex == base.count("hex:")
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))
        assert ("markov" in got[i].spans) == (i == 4), (i, got[i].spans)
    clean = K.redact(docs, tables)
    assert clean.columns == docs.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[0] == 'é token = "[secret]"' and "q8Zr4" not in out[4] and out[8] is None and all(out[i] == texts[i] for i in range(7, len(texts)))
    assert K.scan(docs.where("false").select("doc_id", "text"), K.train(docs.where("false")), ["doc_id"]).count() == 0


def test_random_held_out_strings():
    """Accuracy on strings that the models were not shown."""
    r = random.Random(8)
    counts = np.zeros((4, K.N * K.N), int)
    for i in range(200):
        counts[0] += K.pair_counts(X.prose(200, i).encode())
    tables = K.ratio_tables([(m, p, int(counts[m, p])) for m, p in zip(*np.nonzero(counts))])
    pool = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hits = [any(s[2] == 3 for s in K.find("x " + "".join(r.choice(pool) for _ in range(24)), tables)) for _ in range(300)]
    false = [any(s[2] == 3 for s in K.find("".join(r.choice(X.WORDS) for _ in range(5)), tables)) for _ in range(300)]
    assert np.mean(hits) > 0.97 and not any(false)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C
    assert len(C.STAGES) == 5
    junk = " ".join(f"{w}$$$ {w}###" for w in X.prose(60, 3).split())
    labels = [(i, int(i % 2 == 0)) for i in range(200)]
    texts = [X.prose(60, i).capitalize() + "." if i % 2 == 0 else junk + " " + " ".join(w + "%%%" for w in X.prose(20, i).split()) for i in range(200)]
    texts[10] += " token=" + "0123456789abcdef" * 2
    texts += [texts[0], texts[2], None, ""]
    docs = X.documents(spark, texts, sources=[f"s{i % 3}" for i in range(len(texts))])
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step, kept = docs, []
    for name, stage in C.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
        kept.append([(r.doc_id, r.text) for r in step.collect()])
    good = {i for i, _ in kept[0]}
    assert not good & set(range(1, 200, 2)) and good >= set(range(0, 200, 2)) | {200, 201}
    assert {i for i, _ in kept[1]} == good - {200, 201} - ({203} if {202, 203} <= good else set())
    assert dict(kept[2])[10].endswith("token=[secret]") and {i for i, _ in kept[2]} == {i for i, _ in kept[1]}
    n = Counter(i for i, _ in kept[3])
    assert max(n.values()) <= 2 and set(n) <= {i for i, _ in kept[2]}
    out = C.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in out) == n
    assert all(r.decoded_sha256 == hashlib.sha256((dict(kept[2])[r.doc_id] or "").encode()).hexdigest() for r in out)
