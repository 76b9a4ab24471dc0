"""Quality classifier: gated attention over a document's passages (multiple-instance learning).

A document is a bag of passages of 64 words. A passage is encoded by its content, the mean of learned embeddings of its
hashed character trigrams and words, and by its form, shares of character classes, word lengths and repetition; both go
through one tanh layer. A gated attention (tanh times sigmoid) gives each passage a weight within its document, and the
logistic score reads the weighted sum of the encodings. Embeddings, encoder, attention and score are learned together from
document labels, on a bounded sample of labelled rows; every passage of every document is scored.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import per_text

PASSAGE_WORDS = 64
#: Classes of bytes: lower case, upper case, digits, bytes of non-ASCII characters, blanks, and marks in five groups.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b" ", b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~", b"<>{}[]/\\=+_`"]
_CODE = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES):
    _CODE[list(_c)] = _i
N_FEATURES = len(CLASSES) + 1 + 5
#: Embeddings and their length; bytes that are embedded at once.
BUCKETS, EMBED, BLOCK = 1 << 14, 8, 1 << 18
#: The training sample: documents of each label.
SAMPLE_DOCS = 1500
#: Labels are learned only from rows whose remainder is not this one.
FOLDS, HELD_OUT = 4, 2


_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, np.uint64), dtype=np.uint64)


def _bucket(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.uint16)


class Passages:
    """A text's passages: ``form`` (passages x features), and the buckets of trigrams and words that start in each."""

    def __init__(self, text: str | None):
        words = (text or "").encode().split()
        n = len(words)
        if not n:  # one passage without content
            self.form, self.grams, self.gram_cuts, self.words, self.word_cuts = np.zeros((1, N_FEATURES), np.float32), np.zeros(0, np.uint16), np.zeros(1, int), np.zeros(0, np.uint16), np.zeros(1, int)
            return
        cuts = np.arange(0, n, PASSAGE_WORDS)
        if len(cuts) > 1 and n - cuts[-1] < PASSAGE_WORDS // 4:
            cuts = cuts[:-1]  # a short rest joins the passage before it
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1)
        joined = np.frombuffer(b" ".join(words) + b" ", np.uint8)
        begins = np.concatenate(([0], ends[:-1]))
        starts = begins[cuts]
        sizes = np.diff(np.append(starts, len(joined)))
        m, k = len(cuts), len(CLASSES) + 1
        shares = np.bincount(np.repeat(np.arange(m), sizes) * k + _CODE[joined], minlength=m * k).reshape(m, k) / sizes[:, None]
        count = np.diff(np.append(cuts, n))
        again = np.zeros(n)
        if n > 1:
            again[1:] = np.fromiter(map(operator.eq, words, words[1:]), bool, n - 1)
        bounds = np.append(cuts, n).tolist()
        distinct = np.array([len(set(words[a:b])) for a, b in zip(bounds, bounds[1:])])
        mean = np.add.reduceat(lens, cuts) / count
        spread = np.sqrt(np.maximum(0, np.add.reduceat(lens * lens, cuts) / count - mean ** 2))
        self.form = np.column_stack([shares, np.add.reduceat(again, cuts) / count, distinct / count, np.log1p(mean), np.log1p(spread), np.log1p(count)]).astype(np.float32)
        code = joined.astype(np.uint32)
        code = np.concatenate((code, [32, 32])).astype(np.uint32)
        self.grams = _bucket((code[:-2] | code[1:-1] << 8 | code[2:] << 16).astype(np.uint64))
        place = np.minimum(np.arange(len(joined)) - np.repeat(begins, lens + 1), len(_POWERS) - 1)
        self.words = _bucket(np.add.reduceat((joined + np.uint64(1)) * _POWERS[place], begins))
        self.gram_cuts, self.word_cuts = starts, cuts

    def __len__(self) -> int:
        return len(self.form)

    def content(self, table: np.ndarray) -> np.ndarray:
        """Mean embedding of trigrams plus that of words, by passage."""
        return _means(table, self.grams, self.gram_cuts) + _means(table, self.words, self.word_cuts)


def _means(table: np.ndarray, buckets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    sizes = np.diff(np.append(cuts, len(buckets)))
    out = np.zeros((len(cuts), table.shape[1]))
    start = 0
    while start < len(cuts) and len(buckets):  # long texts in blocks of whole passages
        stop = max(start + 1, int(np.searchsorted(cuts, cuts[start] + BLOCK)))
        end = cuts[stop] if stop < len(cuts) else len(buckets)
        out[start:stop] = np.add.reduceat(table[buckets[cuts[start]:end]], cuts[start:stop] - cuts[start], dtype=float)
        start = stop
    return out / np.maximum(sizes, 1)[:, None]


class GatedAttention:
    """The model; ``fit`` uses Adam on batches of whole documents, ``score`` takes one document at a time or many."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        self.random = r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"We": draw(N_FEATURES + EMBED, hidden), "be": np.zeros(hidden), "V": draw(hidden, gate), "bv": np.zeros(gate), "U": draw(hidden, gate), "bu": np.zeros(gate), "a": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "d": np.zeros(1),
                  "E": r.normal(0, 0.5, (BUCKETS, EMBED))}
        self.mean, self.scale, self.constant = np.zeros(N_FEATURES), np.ones(N_FEATURES), None

    def _inputs(self, bags: list[Passages]) -> tuple[np.ndarray, np.ndarray]:
        form = (np.concatenate([b.form for b in bags]) - self.mean) / self.scale
        return np.column_stack((form, np.concatenate([b.content(self.p["E"]) for b in bags]))), np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))

    def _forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        p, sizes = self.p, np.diff(np.append(at, len(x)))
        h = np.tanh(x @ p["We"] + p["be"])
        t, s = np.tanh(h @ p["V"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        w = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(h * w[:, None], at)
        return {"x": x, "h": h, "t": t, "s": s, "w": w, "z": z, "sizes": sizes, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))}

    def _gradients(self, bags: list[Passages], f: dict, dy: np.ndarray) -> dict:
        p = self.p
        g = {"c": f["z"].T @ dy, "d": np.array([dy.sum()])}
        at = np.concatenate(([0], np.cumsum(f["sizes"])[:-1]))
        dz = np.repeat(dy, f["sizes"])[:, None] * p["c"]
        dw = (dz * f["h"]).sum(axis=1)
        de = f["w"] * (dw - np.repeat(np.add.reduceat(dw * f["w"], at), f["sizes"]))
        g["a"] = (f["t"] * f["s"]).T @ de
        dt, ds = de[:, None] * p["a"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["s"] * (1 - f["s"])
        g |= {"V": f["h"].T @ dt, "bv": dt.sum(axis=0), "U": f["h"].T @ ds, "bu": ds.sum(axis=0)}
        dh = (dz * f["w"][:, None] + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        g |= {"We": f["x"].T @ dh, "be": dh.sum(axis=0)}
        dm, g["E"] = (dh @ p["We"].T)[:, N_FEATURES:], np.zeros_like(p["E"])
        start = 0
        for b in bags:
            part = dm[start:start + len(b)]
            start += len(b)
            for buckets, cuts in ((b.grams, b.gram_cuts), (b.words, b.word_cuts)):
                sizes = np.diff(np.append(cuts, len(buckets)))
                each = np.repeat(np.arange(len(b)), sizes)
                kinds, counts = np.unique(buckets.astype(np.int64) * len(b) + each, return_counts=True)
                np.add.at(g["E"], kinds // len(b), part[kinds % len(b)] * (counts / np.maximum(sizes, 1)[kinds % len(b)])[:, None])
        return g

    def fit(self, bags: list[Passages], labels: list[int], epochs: int = 12, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> "GatedAttention":
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        raw = np.concatenate([b.form for b in bags]).astype(float)
        self.mean, self.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-3
        each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # both labels weigh the same
        m1, m2, p, step = {k: 0 for k in self.p}, {k: 0 for k in self.p}, self.p, 0
        for _ in range(max(epochs, -(-400 * batch // max(len(bags), 400)))):
            order = self.random.permutation(len(bags))
            for k in range(0, len(bags), batch):
                some, step = order[k:k + batch], step + 1
                mine = [bags[i] for i in some]
                f = self._forward(*self._inputs(mine))
                g = self._gradients(mine, f, (f["y"] - y[some]) * each[some] / len(some))
                for name in p:
                    grad = g[name] + decay * p[name]
                    m1[name], m2[name] = 0.9 * m1[name] + 0.1 * grad, 0.999 * m2[name] + 0.001 * grad ** 2
                    p[name] = p[name] - rate * (m1[name] / (1 - 0.9 ** step)) / (np.sqrt(m2[name] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, bags: list[Passages]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        return self._forward(*self._inputs(bags))["y"] if bags else np.zeros(0)


def held_out(id_column: str = "doc_id"):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = SAMPLE_DOCS) -> GatedAttention:
    """Learns from at most ``per_label`` documents of each label outside the held-out fold, those whose ids have the smallest hash.

    An id with several labels has its smallest, one with several texts the first of them in order; labels without a document
    and NULL labels are not used. At most 2 * per_label whole texts come to the driver, which is the bound of what it holds.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    ids = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_label) for y in (0, 1)]
    sample = F.broadcast(ids[0].unionByName(ids[1]))  # at most 2 * per_label ids
    rows = docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return GatedAttention().fit([Passages(r.text) for r in rows], [int(r.y) for r in rows])


def score(docs: DataFrame, model: GatedAttention, keep: list[str], threshold: float = 0.7) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) to the columns ``keep``; NULL is scored as the empty text."""
    def make():
        def run(texts: list) -> list:
            s = model.score([Passages(t) for t in texts])
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
        return run
    return per_text(docs, make, keep, "score double, predicted int")


def keep_good(docs: DataFrame, model: GatedAttention, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    def make():
        return lambda texts: [pa.array(model.score([Passages(t) for t in texts]), pa.float64())]
    return per_text(docs, make, docs.columns, "__score double").where(F.col("__score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
