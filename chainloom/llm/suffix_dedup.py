"""Suffix-array dedup with sparse suffix arrays.

Of every ``length`` consecutive words the position with the smallest word k-gram hash is selected
(leftmost of equal ones), so equal passages select equal positions. Only suffixes at selected
positions are kept: each travels, with the words before it that windows selecting it can reach, to
the bin of its k-gram. There the suffixes of one k-gram are sorted and neighbours compared; runs of
neighbours that agree are extended left, and a word is repeated if a match
of ``length`` words or more that covers it starts earlier elsewhere (in a smaller document, or
earlier in the same one). Runs are worked on as a whole, so pairs of records are never listed.

Scale: as for super-k-mers, a task sends only the first of equal records in a chunk, bins are many
more than partitions and worked on one at a time, and rows are compressed.

Defined results: null text has no words; documents of fewer words than ``length`` repeat nothing;
rows with a null id take no part; repeated rows with one id are one place; long texts are read whole; an empty table gives
an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import takewhile

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import partitions
from chainloom.llm.substring_dedup import _BASE, BINS, CHUNK, LEVEL, Words, _merged, mix, sliding_min

LENGTH = 50
GRAM = 8
#: Low bits of a key that hold a position; the rest holds a hash.
_PLACE = 28


def selected(words: Words, length: int, k: int):
    """Starts of all windows, the selected position of each, and the k-gram hashes."""
    n = len(words.words)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.words), np.uint64, n)
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(_BASE) + h[j : n - k + 1 + j]
    gram = mix(gram)
    low = (1 << _PLACE) - 1
    key = (gram & ~np.uint64(low)) | np.arange(len(gram), dtype=np.uint64)
    best = sliding_min(key, length - k + 1)
    ok = np.ones(n - length + 1, bool)
    for e in words.ends:
        ok[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(ok)
    return starts, (best[starts] & np.uint64(low)).astype(np.int64), gram


def _send(length: int, k: int, bins: int):
    """Rows (bin, blob): records (k-gram hash, document, first word, selected position, words)."""

    def flush(ids, texts):
        words = Words(texts)
        starts, at, gram = selected(words, length, k)
        if not len(starts):
            return
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
        s, e, p = starts[first], starts[last] + length, at[first]
        which = np.searchsorted(words.ends, s, side="right")
        doc, start = np.array(ids, np.int64)[which], s - words.begins[which]
        joined = words.joined
        packed = [joined[a:b] for a, b in zip(words.at[s].tolist(), (words.at[e] - 1).tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        known = np.zeros(len(packed), bool)
        place = list(zip(doc.tolist(), start.tolist(), strict=True))
        for i, x in enumerate(packed):
            j = seen.setdefault(x, i)
            if j != i:
                if place[j] < place[i]:
                    known[i] = True
                elif place[i] < place[j]:
                    known[j], seen[x] = True, i
        mini = gram[p]
        if known.any():
            rows = np.array(_merged(doc[known], start[known], (start + e - s)[known]), np.int64)
            yield -1 - int(mini[0] % np.uint64(bins)), zstandard.ZstdCompressor(level=1).compress(rows.tobytes())
        send = np.flatnonzero(~known)
        to = (mini[send] % np.uint64(bins)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        send, to = send[order], to[order]
        edges = np.flatnonzero(np.diff(to)) + 1
        for part, b in zip(np.split(send, edges), to[np.concatenate([[0], edges])].tolist() if len(to) else [], strict=bool(len(to))):
            head = np.array([len(part)], np.int64).tobytes() + np.diff(doc[part], prepend=0).astype(np.int64).tobytes()
            head += start[part].astype(np.int32).tobytes() + (p - s)[part].astype(np.int32).tobytes() + (mini[part] >> np.uint64(32)).astype(np.uint32).tobytes()
            yield b, zstandard.ZstdCompressor(level=LEVEL).compress(head + b"\n".join([packed[i] for i in part.tolist()]))

    def run(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_buffer()
                if i is None or t is None or len(t) < 2 * length - 1:
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


def common(a: list[bytes], b: list[bytes]) -> int:
    """Words that two lists have in common at the front."""
    return sum(1 for _ in takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False)))


def nearest_earlier(places: list, near: list[int]) -> list[int]:
    """For each of several sorted strings how much it shares, at most, with one of an earlier place; -1 if none is earlier.

    ``near`` holds what neighbours share. Of all strings on one side that are earlier, the nearest shares most.
    """
    n = len(places)
    best = [-1] * n
    for side in (range(n), range(n - 1, -1, -1)):
        back = -1 if side.step > 0 else 0
        stack: list[tuple[int, int]] = []  # earlier ones, each with what it shares with the one below it
        for i in side:
            share = near[i + back] if stack else 0
            while stack and places[stack[-1][0]] >= places[i]:
                share = min(share, stack.pop()[1])
            if stack:
                best[i] = max(best[i], share)
            stack.append((i, share))
    return best


def matches(records: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """Repeated spans (document, first word, end) among records of one k-gram.

    A record is (document, first word, words before the selected one, its words). The suffixes are sorted and neighbours
    compared; a run of suffixes shares, to the right, the least that neighbours in it share. In each run the words
    before are sorted and compared likewise, which extends the matches to the left, and runs are split where they share least.
    """
    items = []
    for doc, start, left, text in records:
        words = text.split(b" ")
        items.append((words[left:], words[:left][::-1], (doc, start + left)))
    items.sort(key=lambda x: x[0])  # the suffixes
    near = [common(a[0], b[0]) for a, b in zip(items, items[1:], strict=False)]
    out = []
    runs = [(0, len(items))]
    while runs:
        lo, hi = runs.pop()
        right = min(near[lo : hi - 1])
        run = sorted(items[lo:hi], key=lambda x: x[1])
        lefts = nearest_earlier([x[2] for x in run], [common(a[1], b[1]) for a, b in zip(run, run[1:], strict=False)])
        out += [(x[2][0], x[2][1] - left, x[2][1] + right) for x, left in zip(run, lefts, strict=True) if left >= 0 and left + right >= length]
        cuts = [lo, *(i + 1 for i in range(lo, hi - 1) if near[i] == right), hi]
        runs += [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
    return out


def _receive(length: int):
    def emit(spans):
        d, s, e = spans
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, s, e)], names=["id", "start", "stop"])

    def found(blobs):
        groups: dict[int, list] = {}
        for blob in blobs:
            raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=0)
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            doc = np.cumsum(np.frombuffer(raw, np.int64, n, 8)).tolist()
            start, left, mini = (np.frombuffer(raw, t, n, 8 + 8 * n + 4 * n * i).tolist() for i, t in enumerate((np.int32, np.int32, np.uint32)))
            for m, *record in zip(mini, doc, start, left, raw[8 + 20 * n :].split(b"\n"), strict=True):
                groups.setdefault(m, []).append(record)
        spans = [x for g in groups.values() if len(g) > 1 for x in matches(g, length)]
        return _merged(*np.array(spans, np.int64).T) if spans else None

    def run(batches):
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b < 0:
                    yield emit(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=0), np.int64).reshape(3, -1))
                    continue
                if b != now:
                    if blobs and (spans := found(blobs)):
                        yield emit(spans)
                    now, blobs = b, []
                blobs.append(blob)
        if blobs and (spans := found(blobs)):
            yield emit(spans)

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM) -> DataFrame:
    """Rows (id, start, stop): word spans that are covered by passages which start earlier elsewhere."""
    if not 1 <= k <= length:
        raise ValueError("a k-gram has from one word up to the passage's")
    n = partitions(df.sparkSession)
    sent = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_send(length, k, BINS * n), "bin bigint, blob binary")
    return sent.repartition(n, "bin").sortWithinPartitions("bin").mapInArrow(_receive(length), "id bigint, start bigint, stop bigint")


def _joined(found):
    """Sorted spans with those that touch or overlap joined, as an array column."""
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] > last["stop"], F.concat(acc, F.array(s))).otherwise(longer)

    return F.aggregate(F.sort_array(found), none, step)


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row of ``df``: (id, n_words, n_repeated, spans); spans are [first word, end), joined."""
    spans = repeated_passages(df, id_col, text_col, length).groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    spans = spans.select(F.col("id").alias("span_id"), _joined(F.col("found")).alias("spans"))
    slim = df.select(F.col(id_col).alias("id"), F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    rows = slim.join(spans, F.col("id").cast("long") == F.col("span_id"), "left")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return rows.select(F.col("id").alias(id_col), "n_words", F.coalesce(total, F.lit(0)).alias("n_repeated"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
