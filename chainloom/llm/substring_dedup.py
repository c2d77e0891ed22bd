"""Substring dedup by super-k-mer partitioning.

A window is ``window`` consecutive words of a document. Consecutive windows whose smallest word
m-gram hash (minimiser) is the same travel as one packed string to the bin of that minimiser.
Equal windows have equal minimisers and so meet in one bin, where windows are sorted by a rolling
hash and compared byte for byte; the first occurrence (smallest document, then smallest start)
stays and the rest are repeats. A document's words that are covered by repeated windows go.

Scale: a task sends, of equal packed strings in a chunk, only the first occurrence, since the
others are repeats whatever the bin says. Bins are many more than partitions, arrive sorted, and
are worked on one at a time, so memory is that of one bin. Chunks of rows for one bin are
compressed. Nothing is collected.

Defined results: null text has no words; a document of fewer words than ``window`` has no window
and keeps all; rows with a null id take no part and keep all; repeated rows with one id are one
occurrence each of the same place, so none of them repeats the other; a text is cut whole, however long, and lies in
one task's memory; an empty table gives an empty result. Columns other than id, text and those to carry are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import partitions

WINDOW = 20
#: Words of an m-gram whose hashes are compared.
MINIMISER = 5
#: Bytes of text that a task cuts into super-k-mers at once.
CHUNK = 8 << 20
#: Bins for each shuffle partition.
BINS = 8
#: Compression level of rows in the shuffle.
LEVEL = 6
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours; the result is shorter by ``width`` - 1."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


class Words:
    """The words of several documents, one after another."""

    def __init__(self, texts: list[bytes]):
        words: list[bytes] = []
        counts = []
        for t in texts:
            w = t.split()
            words += w
            counts.append(len(w))
        self.words = words
        self.ends = np.cumsum(np.array(counts, np.int64))
        self.begins = self.ends - np.array(counts, np.int64)
        self.joined = b" ".join(words)
        length = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.at = np.concatenate([[0], np.cumsum(length)])


def minimisers(words: Words, window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, and the smallest m-gram hash in each."""
    n = len(words.words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.words), np.uint64, n)
    gram = np.zeros(n - m + 1, np.uint64)
    for k in range(m):
        gram = gram * np.uint64(_BASE) + h[k : n - m + 1 + k]
    low = sliding_min(mix(gram), window - m + 1)
    ok = np.ones(n - window + 1, bool)
    for e in words.ends:  # windows that reach into the next document
        ok[max(0, e - window + 1) : e] = False
    starts = np.flatnonzero(ok)
    return starts, low[starts]


def super_kmers(ids: np.ndarray, words: Words, window: int, m: int):
    """(minimiser, document, first word within it, words, packed string) arrays, in text order."""
    starts, low = minimisers(words, window, m)
    if not len(starts):
        return None
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    s, e = starts[first], starts[last] + window
    doc = np.searchsorted(words.ends, s, side="right")
    joined = words.joined
    packed = [joined[a:b] for a, b in zip(words.at[s].tolist(), (words.at[e] - 1).tolist(), strict=True)]
    return low[first], ids[doc], s - words.begins[doc], e - s, packed


def _blob(parts) -> bytes:
    """Super-k-mers as one compressed row; half a minimiser suffices to keep equal ones together."""
    mini, doc, start, packed = parts
    head = np.array([len(mini)], np.int64).tobytes() + np.diff(doc, prepend=0).astype(np.int64).tobytes() + start.astype(np.int32).tobytes() + (mini >> np.uint64(32)).astype(np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=LEVEL).compress(head + b"\n".join(packed))


def _unblob(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=0)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    doc = np.cumsum(np.frombuffer(raw, np.int64, n, 8))
    start = np.frombuffer(raw, np.int32, n, 8 + 8 * n).astype(np.int64)
    mini = np.frombuffer(raw, np.uint32, n, 8 + 12 * n)
    return mini, doc, start, raw[8 + 16 * n :].split(b"\n") if n else []


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Spans with those that touch or overlap joined."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    out_d, out_s, out_e = [], [], []
    for d, a, b in zip(doc.tolist(), s.tolist(), e.tolist(), strict=True):
        if out_d and out_d[-1] == d and a <= out_e[-1]:
            out_e[-1] = max(out_e[-1], b)
        else:
            out_d.append(d), out_s.append(a), out_e.append(b)
    return out_d, out_s, out_e


def _send(window: int, m: int, bins: int):
    """Rows (bin, blob) of super-k-mers; those known to repeat go as spans in a blob of bin -1 - x."""

    def flush(ids, texts):
        words = Words(texts)
        got = super_kmers(np.array(ids, np.int64), words, window, m)
        if got is None:
            return
        mini, doc, start, n, packed = got
        seen: dict[bytes, int] = {}
        known = np.zeros(len(packed), bool)
        place = list(zip(doc.tolist(), start.tolist(), strict=True))
        for i, p in enumerate(packed):
            j = seen.setdefault(p, i)
            if j != i:
                if place[j] < place[i]:
                    known[i] = True
                elif place[i] < place[j]:
                    known[j], seen[p] = True, i
        if known.any():
            d, s, e = _merged(doc[known], start[known], (start + n)[known])
            rows = zstandard.ZstdCompressor(level=1).compress(np.array([d, s, e], np.int64).tobytes())
            yield -1 - int(mini[0] % np.uint64(bins)), rows
        send = np.flatnonzero(~known)
        to = (mini[send] % np.uint64(bins)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        send, to = send[order], to[order]
        edges = np.flatnonzero(np.diff(to)) + 1
        for part, b in zip(np.split(send, edges), to[np.concatenate([[0], edges])].tolist() if len(to) else [], strict=bool(len(to))):
            yield b, _blob((mini[part], doc[part], start[part], [packed[i] for i in part.tolist()]))

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_buffer()
                if i is None or t is None or len(t) < 2 * window - 1:
                    continue
                ids.append(i), texts.append(t.to_pybytes())
                size += len(t)
                if size >= CHUNK:
                    yield from out(flush(ids, texts))
                    ids, texts, size = [], [], 0
        yield from out(flush(ids, texts))

    def out(rows):
        for b, blob in rows:
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([blob], pa.binary())], names=["bin", "blob"])

    return run


def repeats_in_bin(blobs: list[bytes], window: int):
    """Spans (document, first word, end) that are covered by windows seen earlier, in one bin."""
    cols = [_unblob(b) for b in blobs]
    mini, doc, start = (np.concatenate([c[i] for c in cols]) for i in range(3))
    packed = [p for c in cols for p in c[3]]
    order = np.argsort(mini, kind="stable")
    length = np.fromiter(map(len, packed), np.int64, len(packed))[order]
    # pieces of about a megabyte that do not split a minimiser
    upto, key = np.cumsum(length), mini[order]
    found = []
    lo = 0
    while lo < len(order):
        hi = int(np.searchsorted(upto, upto[lo] + (1 << 20), side="right"))
        hi = max(hi, lo + 1)
        hi = int(np.searchsorted(key, key[hi - 1], side="right"))
        part = order[lo:hi]
        if hi - lo > 1 or packed[order[lo]].count(b" ") >= window:  # a lone window cannot repeat itself
            found.append(_sorted_windows(doc[part], start[part], [packed[i] for i in part.tolist()], window))
        lo = hi
    found = [f for f in found if f is not None]
    if not found:
        return None
    return _merged(*(np.concatenate([f[i] for f in found]) for i in range(3)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sorted_windows(doc, start, packed, window):
    buf = b"\n".join(packed) + b"\n"
    raw = np.frombuffer(buf, np.uint8)
    stop = np.flatnonzero((raw == 32) | (raw == 10))  # behind each word
    begin = np.concatenate([[0], stop[:-1] + 1])
    line = np.flatnonzero(raw[stop] == 10) + 1  # words up to the end of each super-k-mer
    first = np.concatenate([[0], line[:-1]])
    windows = line - first - window + 1
    owner = np.repeat(np.arange(len(packed)), windows)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = first[owner] + within
    a, b = begin[at], stop[at + window - 1]
    up, down = _powers(len(raw) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    hashed = mix((total[b] - total[a]) * down[a])
    d, s = doc[owner], start[owner] + within
    order = np.lexsort((s, d, hashed))
    same = hashed[order][1:] == hashed[order][:-1]
    if not same.any():
        return None
    edge = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
    again = np.zeros(len(order), bool)
    many = np.flatnonzero(np.diff(edge) > 1)
    al, bl, dl, sl = a.tolist(), b.tolist(), d, s
    for g in many.tolist():
        group = order[edge[g] : edge[g + 1]].tolist()
        seen: dict[bytes, tuple] = {}
        for i in group:  # by place: the first of equal windows is the earliest
            text, place = buf[al[i] : bl[i]], (dl[i], sl[i])
            if seen.setdefault(text, place) != place:
                again[i] = True
    hit = np.flatnonzero(again)
    if not len(hit):
        return None
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
    f = np.flatnonzero(new)
    last = np.concatenate([f[1:] - 1, [len(hit) - 1]])
    return d[hit[f]], s[hit[f]], s[hit[last]] + window


def _receive(window: int):
    def emit(spans):
        d, s, e = spans
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, e)], names=["id", "start", "stop"])

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b < 0:
                    spans = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=0), np.int64).reshape(3, -1)
                    yield emit(spans)
                    continue
                if b != now:
                    if blobs and (spans := repeats_in_bin(blobs, window)):
                        yield emit(spans)
                    now, blobs = b, []
                blobs.append(blob)
        if blobs and (spans := repeats_in_bin(blobs, window)):
            yield emit(spans)

    return run


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, minimiser: int | None = None) -> DataFrame:
    """Rows (id, start, stop): word spans covered by windows that start earlier elsewhere.

    ``id_col`` must hold integers. Spans of one document may overlap.
    """
    minimiser = min(MINIMISER, window) if minimiser is None else minimiser
    if not 1 <= minimiser <= window:
        raise ValueError("a minimiser has from one word up to the window's")
    n = partitions(df.sparkSession)
    sent = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_send(window, minimiser, BINS * n), "bin bigint, blob binary")
    return sent.repartition(n, "bin").sortWithinPartitions("bin").mapInArrow(_receive(window), "id bigint, start bigint, stop bigint")


def kept_words(words: list[bytes], spans: list) -> tuple[list[bytes], int]:
    """The words outside ``spans``, and how many are inside."""
    if not spans:
        return words, 0
    out, at = [], 0
    for s, e in sorted(spans):
        out += words[at : max(at, s)]
        at = max(at, e)
    out += words[at:]
    return out, len(words) - len(out)


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep: str = "words", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``df``: (id, n_words, n_removed, kept_text or kept_sha256, then ``carry``).

    ``keep`` tells what is kept: "words" joined by blanks, their "digest", or the "whole" text as it was where nothing
    was removed and else the words. The columns named in ``carry`` pass through; of a name that the result has already, its
    own column is returned.
    """
    if keep not in ("words", "digest", "whole"):
        raise ValueError(f"unknown kind of result: {keep}")
    carry = list(carry or [])
    name = "kept_sha256" if keep == "digest" else "kept_text"
    carry = [c for c in carry if c not in (id_col, "n_words", "n_removed", name)]
    spans = repeated_spans(df, id_col, text_col, window).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    kind = df.schema[id_col].dataType.simpleString()
    passed = [f"pass_{i}" for i in range(len(carry))]
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"), *[F.col(c).alias(p) for c, p in zip(carry, passed, strict=True)])
    joined = docs.join(spans, F.col("doc").cast("long") == spans["id"], "left").select("doc", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"), *passed)

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, stops in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                whole = text.as_py()
                words = (whole or b"").split()
                left, gone = kept_words(words, list(zip(starts.as_py(), stops.as_py(), strict=True)) if starts.is_valid else [])
                out = whole if keep == "whole" and not gone else b" ".join(left)
                n_words.append(len(words)), n_removed.append(gone), kept.append(hashlib.sha256(out).hexdigest() if keep == "digest" else out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), *[batch.column(4 + i) for i in range(len(passed))]], names=["id", "n_words", "n_removed", name, *passed])

    more = "".join(f", {p} {df.schema[c].dataType.simpleString()}" for c, p in zip(carry, passed, strict=True))
    out = joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, {name} string{more}")
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", name, *[F.col(p).alias(c) for c, p in zip(carry, passed, strict=True)])
