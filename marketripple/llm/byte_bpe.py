"""Byte-level BPE with the tokenizers library over Arrow batches, from a file of byte ranks.

Bytes are written as printable characters (the byte table below), so the rank file's byte strings become a vocabulary of
strings. Every way to join two tokens into a listed one is a merge, in rank order, which makes the library merge as the
rank file's own algorithm does. Texts are cut by the file's pattern; a piece is encoded once per worker while the bounded
memo holds it, always by the library. Decoding reverses the byte table; a character that is split between tokens comes
out whole once its bytes are joined, and as U+FFFD where an id range cuts it.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from marketripple.llm.common import per_text

#: The bytes that stand for themselves; the others follow, in order, from U+0100 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Pieces that a worker remembers, and the longest piece remembered. These bound memory only.
MEMO, MEMO_PIECE = 400_000, 64
#: Characters of a text that are cut into pieces at once.
BLOCK = 1_000_000
_EDGE = regex.compile(r"(?<=\S)(?= )")


def byte_table() -> list[str]:
    """The character of each byte."""
    rest = iter(range(256, 512))
    return [chr(b) if b in set(PRINTABLE) else chr(next(rest)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def _as_chars(word: bytes, table: list[str]) -> str:
    return "".join(map(table.__getitem__, word))


class ByteBpe:
    """Encoder and decoder of one rank file; ``pattern`` cuts texts into pieces."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers
        ranks, chars = load_ranks(path), byte_table()
        pairs = [(word[:i], word[i:]) for word in sorted(ranks, key=ranks.get) for i in range(1, len(word))
                 if ranks.get(word[:i], rank := ranks[word]) < rank and ranks.get(word[i:], rank) < rank]
        model = models.BPE(vocab={_as_chars(w, chars): r for w, r in ranks.items()},
                           merges=[(_as_chars(a, chars), _as_chars(b, chars)) for a, b in pairs], ignore_merges=True)
        self.library = Tokenizer(model)
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {i: bytes(back[c] for c in w) for w, i in self.library.get_vocab().items()}
        self.pattern = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[str]:
        """Matches of the pattern. Long texts go block by block, cut before a space that follows another character:
        no match reaches over such a place."""
        at = 0
        while at < len(text):
            edge = _EDGE.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = edge.start() if edge else len(text)
            yield from self.pattern.findall(text[at:end] if at or edge else text)
            at = end

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [list(self.pieces(t)) for t in texts]
        memo = self.memo
        new = list({p for c in cut for p in c if p not in memo})
        fresh: dict[str, bytes] = {}
        for k in range(0, len(new), 4096):
            some = new[k:k + 4096]
            fresh.update(zip(some, (np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(some, add_special_tokens=False))))
        out = [b"".join([memo[p] if p in memo else fresh[p] for p in c]) for c in cut]
        if len(memo) > MEMO:
            memo.clear()
        memo.update((p, v) for p, v in fresh.items() if len(p) <= MEMO_PIECE)
        return out

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the code points (start, end) each comes from; tokens that share a split character overlap on it."""
        ids, spans, at = [], [], 0
        for piece in self.pieces(text):
            for e in self.library.encode_batch([piece], add_special_tokens=False):
                ids += e.ids
                spans += [(at + a, at + b) for a, b in e.offsets]
            at += len(piece)
        return ids, spans

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text; bytes of a character that the ids cut in two become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _once(path: str, pattern: str) -> Callable[[], ByteBpe]:
    """Builds the encoder at first use in a worker; workers that are used again keep it."""
    def get() -> ByteBpe:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if (path, pattern) not in _BUILT:
            _BUILT[path, pattern] = ByteBpe(path, pattern)
        return _BUILT[path, pattern]
    return get


_BUILT: dict = {}


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str], column: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int), ``starts`` and ``ends`` (code point offsets). NULL counts as the empty text: no ids."""
    get = _once(path, pattern)

    def make():
        bpe = get()

        def run(texts: list) -> list:
            made = [bpe.encode(t or "") for t in texts]
            return [[m[0] for m in made], [[a for a, _ in m[1]] for m in made], [[b for _, b in m[1]] for m in made]]
        return run
    return per_text(docs, make, keep, "ids array<int>, starts array<int>, ends array<int>", column)


def decode(rows: DataFrame, path: str, pattern: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary, exact) and ``decoded_text`` (split characters as U+FFFD) of an id array. NULL decodes to nothing."""
    get = _once(path, pattern)
    kept = rows.select(*keep, ids)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", decoded binary, decoded_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = get()
        for b in batches:
            raw = [bpe.decode_bytes(x or []) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(raw, pa.binary()),
                                              pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], names=[*keep, "decoded", "decoded_text"])
    return kept.mapInArrow(run, out)


def digests(docs: DataFrame, path: str, pattern: str, keep: list[str], column: str = "text") -> DataFrame:
    """Encodes every text, decodes the ids again, and adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    The ids are hashed as little-endian unsigned 32-bit integers, the decoded bytes as they are. NULL counts as empty;
    repeated rows are encoded each; an empty table gives no rows.
    """
    get = _once(path, pattern)

    def make():
        bpe = get()

        def run(texts: list) -> list:
            words = bpe.encode_words([t or "" for t in texts])
            back = [bpe.decode_bytes(np.frombuffer(w, "<u4").tolist()) for w in words]
            return [[len(w) // 4 for w in words], [hashlib.sha256(w).hexdigest() for w in words], [hashlib.sha256(b).hexdigest() for b in back]]
        return run
    return per_text(docs, make, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", column)
