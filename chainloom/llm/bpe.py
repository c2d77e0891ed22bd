"""BPE encoding and decoding with a public byte-level vocabulary file.

Merging keeps a priority queue of (merge rank, left position) over a doubly linked list of
symbols. A queue entry is stale when one of its two symbols has changed since it was pushed; it
is skipped when popped. Decoding concatenates the byte strings of the vocabulary.

Work is one pass over the rows, without a shuffle. Every Python worker keeps a bounded cache from
pre-tokens to their packed ids, because words repeat.

Defined results: null text is the empty text, which has no ids; the string of a special token in a
text becomes that token's id, as the tokenizers library does by default; long texts are encoded
whole. Other columns of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers at most.
CACHE = 400_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file.

    Bytes that print in Latin-1 stand for themselves; the rest take code points from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    shown = set(own)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder for the vocabulary file (JSON) at ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        raw = {tok: bytes(back[c] for c in tok) for tok in spec["model"]["vocab"]}
        self.ids = {raw[tok]: i for tok, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in self.ids.items():
            self.strings[i] = s
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        #: (left id, right id) -> (rank, merged id)
        self.merges = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            left, right = raw[a], raw[b]
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(piece)
        sym: list[int] = [self.bytes[b] for b in piece]
        n = len(sym)
        if n == 1:
            return sym
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((sym[i], sym[i + 1]))
            if found:
                queue.append((found[0], i, found[1], sym[i], sym[i + 1]))
        if not queue:
            return sym
        heapify(queue)
        while queue:
            _, i, new, left, right = heappop(queue)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue  # stale
            sym[i], sym[j] = new, -1
            if new == whole:
                return [new]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, sym[k]))
                if found:
                    heappush(queue, (found[0], i, found[1], new, sym[k]))
            p = before[i]
            if p >= 0:
                found = merges.get((sym[p], new))
                if found:
                    heappush(queue, (found[0], p, found[1], sym[p], new))
        return [s for s in sym if s >= 0]

    def _packed(self, piece: str) -> bytes:
        ids = array("I", self.merge(piece.encode()))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        out = self.cache[piece] = ids.tobytes()
        return out

    def _plain(self, text: str) -> bytes:
        pieces = self.split.findall(text)
        try:
            return b"".join(map(self.cache.__getitem__, pieces))
        except KeyError:
            get, make = self.cache.get, self._packed
            return b"".join([get(p) or make(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned 32-bit integers in the machine's order (little-endian)."""
        if not self.cut or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._plain(x) for x in self.cut.split(text) if x)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = array("I")
        ids.frombytes(packed)
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The tokenizer of a path, once for each Python worker."""
    return Bpe(path)


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows (id, n_tokens, ids: packed little-endian uint32, decoded) of ``df``.

    ``path`` is the vocabulary file; it must be readable on every executor. With ``keep_text``
    false, the decoded text travels as its SHA-256 only (``decoded_sha256``) and the ids as
    ``ids_sha256``, so the result stays small.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            ids, rows = batch.column(0), []
            for text in batch.column(1):
                text = text.as_py() or ""
                packed = bpe.encode(text)
                back = bpe.decode(packed)
                rows.append((len(packed) // 4, packed, back) if keep_text else (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary() if keep_text else pa.string()), pa.array(cols[2], pa.string())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids", "decoded"] if keep_text else ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"id {kind}, n_tokens bigint, " + ("ids binary, decoded string" if keep_text else "ids_sha256 string, decoded_sha256 string")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
