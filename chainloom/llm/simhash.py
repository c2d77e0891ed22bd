"""SimHash near-dedup with a binary trie self-join.

A document's fingerprint has bit b set when over half of its word-shingle hashes have it set.
Fingerprints may have one block of 64 bits (two documents link when it differs in at most
``budget`` bits), or several blocks of 32 bits (they link when some block differs in at most
``budget`` bits and the whole in at most ``total`` bits).

The self-join goes over distinct fingerprints. Two that differ in at most ``budget`` bits agree in
one of ``budget`` + 1 bands, so each is sent once for each band, keyed by the band's bits. There the
rest of the block is a binary trie over the sorted values: pairs of nodes go down together,
differing bits add up, and a pair whose sum is over the budget is pruned. A task joins what it
finds into groups at once and emits one link for each member at most, never all pairs.
Components come from rounds of joins that are cut by checkpoints in the shared folder.

Defined results: null text is the empty text; a text of fewer words than a shingle is one
shingle; a text without words has fingerprint zero, which links like any other; a null id takes
the component of its fingerprint (null if no row there has an id); repeated rows each return.
Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import cut, partitions

_STEP, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of one piece of a partition that the trie holds at once, if keys allow.
PIECE = 200_000
#: Node pairs that go down together at once.
FRONTIER = 1 << 20


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """``words`` independent 64-bit hashes of each hash; the first is the hash itself."""
    if words == 1:
        return h[:, None]
    x = h[:, None] + np.arange(words, dtype=np.uint64) * _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    x ^= x >> np.uint64(31)
    x[:, 0] = h
    return x


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of ``text``, A-Z lower-cased, repeats included."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], np.uint64)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=at[1:])
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(whole[a:b], 42) for a, b in zip(at[: n - size + 1].tolist(), (at[size:] - 1).tolist(), strict=True)], np.uint64, n - size + 1)


def fingerprint(text: bytes, size: int, words: int = 1) -> bytes:
    """The fingerprint of ``text``: ``words`` little-endian 64-bit words."""
    return of_hashes(shingle_hashes(text, size), words)


def of_hashes(h: np.ndarray, words: int = 1) -> bytes:
    """The fingerprint of shingle hashes."""
    n = len(h)
    if not n:
        return bytes(8 * words)
    total = np.zeros(64 * words, np.int64)
    for i in range(0, n, 255 * 64):
        bits = np.unpackbits(spread(h[i : i + 255 * 64], words).view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # 255 ones fit in a byte
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").tobytes()


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3, words: int = 1) -> DataFrame:
    """Rows (id, fp): one for each row of ``df``."""

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py() or b"", shingle, words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.binary())], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "id bigint, fp binary")


def bands(bits: int, budget: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of ``budget`` + 1 bands of a block."""
    edges = [bits * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def block_values(fps: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks of fingerprints (rows of 64-bit words): one of 64 bits, or several of 32."""
    if blocks == 1:
        return fps
    return fps.view(np.uint32).astype(np.uint64)


def _keys(blocks: int, bits: int, budget: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fps = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(n, -1)
            value = block_values(fps, blocks)
            for b in range(blocks):
                for i, (low, width) in enumerate(bands(bits, budget)):
                    part = (value[:, b] >> np.uint64(low)) & np.uint64((1 << width) - 1)
                    key = (np.uint64((b * 16 + i) << 32) | part).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(1)], names=["key", "fp", "rep"])

    return run


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def settle(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of u and v; a label is the smallest index of its group."""
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def trie_self_join(group: np.ndarray, rest: np.ndarray, width: int, budget: int, linked) -> np.ndarray:
    """Group labels of rows whose ``rest`` (``width`` bits) differ in at most ``budget`` bits.

    ``group`` holds ascending integers; rows of different groups never link. ``linked(i, j)`` says
    which of the pairs found are links.
    """
    label = np.arange(len(group))
    for u, v in trie_pairs(group, rest, width, budget):
        good = linked(u, v)
        label = settle(label, u[good], v[good])
    return label


def trie_pairs(group: np.ndarray, rest: np.ndarray, width: int, budget: int, settled: np.ndarray | None = None):
    """Arrays (u, v) of the pairs of rows whose ``rest`` differ in at most ``budget`` bits.

    With ``settled``, pairs of nodes whose rows all have one and the same value there are pruned as
    well; single pairs with equal values may still be among the result.
    """
    value = (group.astype(np.uint64) << np.uint64(width)) | rest
    order = np.argsort(value, kind="stable")
    value = value[order]
    owner = value >> np.uint64(width)
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    if settled is not None:
        known = settled[order]
        turns = np.cumsum(np.concatenate([[0], (known[1:] != known[:-1]).astype(np.int64)]))
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int64), width - 1)]
    while stack:
        al, ah, bl, bh, diff, bit = stack.pop()
        if settled is not None and len(al):
            open_ = (known[al] != known[bl]) | (turns[al] != turns[ah - 1]) | (turns[bl] != turns[bh - 1])
            al, ah, bl, bh, diff = (x[open_] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(al[:half], ah[:half], bl[:half], bh[:half], diff[:half], bit), (al[half:], ah[half:], bl[half:], bh[half:], diff[half:], bit)]
            continue
        area = (ah - al) * (bh - bl)
        small = (area <= 64) | (bit < 0)
        if small.any():
            for k in _slices(area[small]):
                a0, a1, b0, b1 = (x[small][k] for x in (al, ah, bl, bh))
                yield from _near(value, order, budget, a0, a1, b0, b1)
        if small.all():
            continue
        al, ah, bl, bh, diff = (x[~small] for x in (al, ah, bl, bh, diff))
        one = np.uint64(1 << bit)
        below = ~np.uint64((2 << bit) - 1)
        am = np.clip(np.searchsorted(value, (value[al] & below) | one), al, ah)
        bm = np.clip(np.searchsorted(value, (value[bl] & below) | one), bl, bh)
        same = al == bl
        parts = [(al, am, bl, bm, diff), (am, ah, bm, bh, diff), (al, am, bm, bh, diff + 1), (am[~same], ah[~same], bl[~same], bm[~same], diff[~same] + 1)]
        al, ah, bl, bh, diff = (np.concatenate([p[i] for p in parts]) for i in range(5))
        keep = (diff <= budget) & (ah > al) & (bh > bl) & ((al != bl) | (ah - al > 1))
        stack.append((al[keep], ah[keep], bl[keep], bh[keep], diff[keep], bit - 1))


def _near(value, order, budget: int, a0, a1, b0, b1, most: int = 1 << 21):
    """The pairs within budget between rows a0 to a1 and b0 to b1 of each two nodes, ``most`` at once."""
    for x in range(0, int((a1 - a0).max()), max(1, most // int((b1 - b0).sum()))):
        step = max(1, most // int((b1 - b0).sum()))
        c0, c1 = np.minimum(a0 + x, a1), np.minimum(a0 + x + step, a1)
        size = (c1 - c0) * (b1 - b0)
        of = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        u, v = c0[of] + at // (b1 - b0)[of], b0[of] + at % (b1 - b0)[of]
        keep = u < v
        u, v = u[keep], v[keep]
        near = popcount(value[u] ^ value[v]) <= budget
        if near.any():
            yield order[u[near]], order[v[near]]


def _slices(sizes: np.ndarray, most: int = 1 << 21):
    """Runs of rows whose sizes sum to about ``most``."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def _links(blocks: int, bits: int, budget: int, total: int):
    layout = bands(bits, budget)

    def piece(key, fps, rep):
        key, fps, rep = np.concatenate(key), np.concatenate(fps), np.concatenate(rep)
        order = np.argsort(key, kind="stable")
        key, fps, rep = key[order], fps[order], rep[order]
        code = key >> 32
        for c in np.unique(code).tolist():
            mine = np.flatnonzero(code == c)
            k, f, r = key[mine], fps[mine], rep[mine]
            low, width = layout[c % 16]
            value = block_values(np.ascontiguousarray(f), blocks)[:, c // 16]
            upper = value >> np.uint64(low + width) if low + width < 64 else np.zeros_like(value)
            rest = (upper << np.uint64(low)) | (value & np.uint64((1 << low) - 1))
            group = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
            linked = (lambda u, v: np.ones(len(u), bool)) if blocks == 1 else (lambda u, v, f=f: popcount(f[u] ^ f[v]).sum(axis=1) <= total)
            label = trie_self_join(group, rest, bits - width, budget, linked)
            if (label == np.arange(len(label))).all():
                continue
            low_rep = np.full(len(r), np.iinfo(np.int64).max)
            np.minimum.at(low_rep, label, r)
            to = low_rep[label]
            off = np.flatnonzero(to != r)
            yield pa.RecordBatch.from_arrays([pa.array(to[off]), pa.array(r[off])], names=["u", "v"])

    def run(batches):
        held, n = ([], [], []), 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            key = batch.column(0).to_numpy()
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(rows, -1)
            rep = batch.column(2).to_numpy()
            if n >= PIECE and (new := np.flatnonzero(key != held[0][-1][-1])).size:
                at = int(new[0])
                if at:
                    for h, x in zip(held, (key[:at], fps[:at], rep[:at]), strict=True):
                        h.append(x)
                yield from piece(*held)
                held, n = ([], [], []), 0
                key, fps, rep = key[at:], fps[at:], rep[at:]
            for h, x in zip(held, (key, fps, rep), strict=True):
                h.append(x)
            n += len(key)
        if n:
            yield from piece(*held)

    return run


def components(links: DataFrame) -> DataFrame:
    """Rows (v, label): for each end of a link (u, v) the smallest end it can reach.

    Rounds of taking the neighbours' smallest label and then the label's label; links go in both
    directions. Each round is cut by a checkpoint; only a count comes to the driver.
    """
    edges = cut(links.union(links.select("v", "u")).distinct())
    label = cut(edges.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = edges.join(label.withColumnRenamed("v", "w"), edges["u"] == F.col("w")).groupBy("v").agg(F.min("label").alias("m"))
        low = label.join(near, "v").select("v", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        up = label.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = cut(low.join(up, "label", "left").select("v", F.least("label", F.coalesce("next", "label")).alias("label"), "old"))
        moved = new.where("label != old").limit(1).count()
        label = new.select("v", "label")
        if not moved:
            return label


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, blocks: int = 1, total: int | None = None) -> DataFrame:
    """Rows (id, fp, component): the smallest id that links reach, itself included.

    ``blocks`` 1 takes 64-bit fingerprints; more take that many blocks of 32 bits (an even
    number), and ``total`` bits of the whole may differ.
    """
    bits, words = (64, 1) if blocks == 1 else (32, blocks // 2)
    prints = cut(fingerprints(df, id_col, text_col, shingle, words))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    spark = df.sparkSession
    sent = distinct.where("rep is not null").mapInArrow(_keys(blocks, bits, budget), "key bigint, fp binary, rep bigint")
    links = sent.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_links(blocks, bits, budget, total or 0), "u bigint, v bigint")
    label = components(links)
    of_print = distinct.join(label, F.col("rep") == F.col("v"), "left").select(F.col("fp").alias("p"), F.coalesce("label", "rep").alias("component"))
    return prints.join(of_print, F.col("fp") == F.col("p"), "left").select(F.col("id").alias(id_col), "fp", "component")
