"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Labelled samples come from the whole corpus: what the fixed patterns find is random; every other run of token characters
is ordinary, but for long ones with a digit, which are left unlabelled. Bigrams of characters are counted inside the tasks and summed; a count table has at most 72 x 72 cells for
each model. Random strings are modelled by alphabet (hexadecimal, upper case, mixed), each also shown generated strings,
so that scarce alphabets have a model too. A long token is a secret if its log-likelihood ratio, the best random model
against the ordinary one, is high enough in all and per character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketripple.llm.common import per_text, slices

#: Fixed patterns; all matches are taken leftmost and without overlap per kind, then those that fail are dropped.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs of 20 and more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Least log-likelihood ratio of a token in all and per character.
LEAST_RATIO, LEAST_MEAN = 12.0, 0.4

SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
CODE = np.zeros(256, np.int64)  # 0: ends a token
for _i, _b in enumerate(SYMBOLS):
    CODE[_b] = _i + 1
N = len(SYMBOLS) + 1
ORDINARY, RANDOM = 0, ("hex", "upper", "mixed")
GENERATED = 400
#: Weight of single characters in a context's distribution.
BACK = 2.0


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0, m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def alphabet(value: str) -> int:
    """Which random model a value trains."""
    return 1 if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else 2 if re.fullmatch(r"[A-Z0-9]+", value) else 3


def _if_plain(m: re.Match) -> str:
    return " " if any(c.isdigit() for c in m.group()) else m.group()


def pair_counts(text: bytes) -> np.ndarray:
    """Counts of adjacent symbol codes; code 0 stands for everything that ends a token."""
    c = CODE[np.frombuffer(b" " + text + b" ", np.uint8)]
    return np.bincount(c[:-1] * N + c[1:], minlength=N * N)


def generated_strings(seed: int = 5) -> dict[int, list[str]]:
    r = np.random.default_rng(seed)
    pools = {1: "0123456789abcdef", 2: "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 3: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    return {m: ["".join(np.array(list(p))[r.integers(0, len(p), 40)]) for _ in range(GENERATED)] for m, p in pools.items()}


def corpus_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(model, pair, n) over all texts: model 0 ordinary, 1 to 3 random by alphabet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, N * N), np.int64)
        for b in batches:
            for part in slices(b):
                for text in part.column(0).to_pylist():
                    if not text:
                        continue
                    spans, at, plain = base_spans(text), 0, []
                    for start, end, _, inner in spans:
                        sums[alphabet(text[inner:end])] += pair_counts(text[inner:end].encode())
                        plain.append(text[at:start])
                        at = max(at, end)
                    plain.append(text[at:])
                    sums[ORDINARY] += pair_counts(TOKEN.sub(_if_plain, " ".join(plain)).encode())
        model, pair = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(sums[model, pair])], names=["model", "pair", "n"])

    return docs.select(F.col(column).alias("text")).mapInArrow(run, "model int, pair int, n bigint").groupBy("model", "pair").agg(F.sum("n").alias("n"))


def ratio_tables(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """(random models x pairs) log-likelihood differences to the ordinary model."""
    sums = np.zeros((4, N * N))
    for model, pair, n in counts:
        sums[model, pair] = n
    for model, strings in generated_strings().items():
        for s in strings:
            sums[model] += pair_counts(s.encode())
    pairs = sums.reshape(4, N, N)
    single = pairs.sum(axis=1) + 0.05
    single /= single.sum(axis=1, keepdims=True)
    p = (pairs + BACK * single[:, None, :]) / (pairs.sum(axis=2, keepdims=True) + BACK)  # rare contexts lean on single characters
    logs = np.log(p).reshape(4, N * N)
    return logs[1:] - logs[ORDINARY]


def train(docs: DataFrame, column: str = "text") -> np.ndarray:
    """The ratio tables of a corpus; at most 4 * 72 * 72 sums come to the driver. An empty corpus leaves the generated strings only."""
    return ratio_tables([tuple(r) for r in corpus_counts(docs, column).collect()])


def find(text: str, tables: np.ndarray) -> list[tuple[int, int, int, int]]:
    """All spans: the fixed ones, and tokens that the models call random and that touch no fixed span."""
    base = base_spans(text)
    more = []
    for m in TOKEN.finditer(text):
        c = CODE[np.frombuffer(m.group().encode(), np.uint8)]
        ratio = float(tables[:, c[:-1] * N + c[1:]].sum(axis=1).max())
        if ratio >= LEAST_RATIO and ratio >= LEAST_MEAN * (len(c) - 1) and not any(s < m.end() and m.start() < e for s, e, _, _ in base):
            more.append((m.start(), m.end(), 3, m.start()))
    return sorted(base + more, key=lambda s: (s[0], s[2], s[1]))


def joined(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans)


def scan(docs: DataFrame, tables: np.ndarray, keep: list[str], column: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans (code points, end exclusive). NULL counts as the empty text."""
    def make():
        def run(texts: list) -> list:
            found = [find(t or "", tables) for t in texts]
            n = [[sum(s[2] == k for s in f) for f in found] for k in range(3)]
            return [*n, [hashlib.sha256(joined([s for s in f if s[2] < 3]).encode()).hexdigest() for f in found], [joined(f) for f in found]]
        return run
    return per_text(docs, make, keep, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", column)


def redacted(text: str, spans: list[tuple[int, int, int, int]], mark: str = "[secret]") -> str:
    """The text with each secret (of an assignment, its value) as ``mark``; overlapping ones as one."""
    out, at = [], 0
    for start, end in sorted((inner, b) for _, b, _, inner in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tables: np.ndarray, column: str = "text") -> DataFrame:
    """The same rows and columns with secrets redacted in ``column``; NULL stays NULL."""
    names = docs.columns

    def make():
        return lambda texts: [[None if t is None else redacted(t, find(t, tables)) for t in texts]]

    return per_text(docs, make, [c for c in names if c != column], f"`{column}` string", column).select(*names)
