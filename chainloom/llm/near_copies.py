"""Near copies by SimHash: the trie join finds candidates, their sets of word shingles decide.

A document's fingerprint is the 512-bit SimHash of its set of word shingles. Two documents link when
their sets share ``likeness`` of their union or more; a group is what links reach. Documents with equal
sets are held as one.

Candidates: two sets at that likeness differ in some 15 of 100 bits. Each fingerprint is sent under
``keys`` keys of ``width`` of its bits, so many that all keys miss such a pair in 5 of 1,000 cases. Under one key
a binary trie over bits that are in no key is joined with itself, and node pairs are pruned beyond
the error budget, which lies 3 standard deviations above what such a pair differs in; sets whose sizes differ too much are no candidates.
No pair links without its sets being compared.

Pairs are not listed inside groups of copies. First all rows of a cluster are compared with the one
in its middle. Where a cluster still holds several groups, each row is compared with the nearest
of another group (by the bits that travel). What is then still apart is compared inside the tasks: clusters that share
rows go to one bin, where each text is read once, the sets outside each cluster's largest group are held, and all its
rows are compared with them. A bin emits only links that join two of its groups, so its rows never grow with the
number of pairs; there no error budget is applied.

Scale: keys travel with 128 bits of the fingerprint. The width grows with the logarithm of the number of sets, so a key has
some 256 sets by chance, and the number of keys follows from the width. Texts travel for candidates only.
The candidates' ids are broadcast to the scan below ``BROADCAST_ROWS`` rows of four numbers; beyond, the same join shuffles.
A middle with many candidates is sent to as many tasks as ``SHARE`` of them each need. All rows of one key are held by one task.
A bin holds some ``HELD`` shingles; a cluster with more outside its largest group is dealt in blocks, each of which meets all rows of the
cluster. The time of this comparison, not its rows, grows with a cluster's rows times those outside its largest group.

Defined results: null text is the empty text; texts without words are equal; a text of fewer words
than a shingle is one shingle; long texts are read whole; an id names one document, so texts that share an id share its
group; a null id takes the group of its set (null if no row there has an id); repeated rows each return; an
empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.llm.common import cut, partitions
from chainloom.llm.simhash import PIECE, components, of_hashes, popcount, shingle_hashes, trie_pairs, trie_self_join

#: 64-bit words of a fingerprint; the first ``HEAD`` are in no key and travel with each.
WORDS, HEAD = 8, 2
#: Share of pairs just at the likeness that no key may bring together.
LOST = 0.005
#: Sets that meet under one key by chance, about; and the least bits of a key.
MEET, LEAST_WIDTH = 256, 16
#: Rows of one key beyond which what is near to the middle is taken out before the trie is built.
HOT = 4_096
#: Rows of candidates that may be broadcast: four numbers each, 20 MB at most.
BROADCAST_ROWS = 200_000
#: Candidates of one middle that a task compares, about.
SHARE = 256
#: Shingles that a bin holds, about.
HELD = 1 << 20


def differing(likeness: float) -> float:
    """The chance that a bit differs between two sets of equal size at ``likeness``."""
    return math.acos(min(1.0, 2 * likeness / (1 + likeness))) / math.pi


def budget(bits: int, likeness: float) -> int:
    """Bits in which two such sets differ at most, but for 1 to 2 of 1,000 pairs."""
    p = differing(likeness)
    return math.ceil(p * bits + 3 * math.sqrt(p * (1 - p) * bits))


def comparable(n: np.ndarray, u, v, likeness: float) -> np.ndarray:
    """Whether sets of sizes ``n[u]`` and ``n[v]`` can be that much alike."""
    return np.minimum(n[u], n[v]) >= likeness * np.maximum(n[u], n[v]) - 1e-6


def layout(sets: int, likeness: float) -> tuple[int, int]:
    """(width, keys) for a number of sets."""
    width = max(LEAST_WIDTH, math.ceil(math.log2(max(1, sets / MEET))))
    agree = (1 - differing(likeness)) ** width
    return width, max(1, math.ceil(math.log(LOST) / math.log1p(-agree))) if agree < 1 else 1


def key_bits(width: int, keys: int) -> np.ndarray:
    """The positions of each key's bits; keys from one shuffle of the positions share none."""
    held = np.arange(64 * HEAD, 64 * WORDS)
    each = len(held) // width
    rows = [np.random.default_rng(k).permutation(held)[: each * width].reshape(each, width) for k in range(-(-keys // each))]
    return np.concatenate(rows)[:keys]


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes of the word shingles of ``text``, in order."""
    return np.unique(shingle_hashes(text, size))


def alike(a: np.ndarray, b: np.ndarray, likeness: float) -> bool:
    """Whether two sets share ``likeness`` of their union or more."""
    most = max(len(a), len(b))
    if not most or min(len(a), len(b)) / most < likeness:
        return not most
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= likeness


def _signatures(size: int):
    def run(batches):
        for batch in batches:
            prints, counts, fps = [], [], []
            for t in batch.column(1):
                s = shingle_set(t.as_py() or b"", size)
                prints.append(xxhash.xxh3_128_digest(s.tobytes())), counts.append(len(s)), fps.append(of_hashes(s, WORDS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(fps, pa.binary())], names=["id", "print", "n", "fp"])

    return run


def _words(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _keys(width: int, keys: int):
    """Rows (key, a, b, n, id): ``keys`` for each set, with the head of its fingerprint."""

    def run(batches):
        places = key_bits(width, keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = _words(batch.column(1))
            bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")
            a, b = (pa.array(np.ascontiguousarray(fps[:, k]).view(np.int64)) for k in range(HEAD))
            for k, at in enumerate(places):
                raw = np.zeros((len(bits), 64), np.uint8)
                raw[:, :width] = bits[:, at]
                key = np.packbits(raw, axis=1, bitorder="little").view(np.int64)[:, 0] | (k << width)
                yield pa.RecordBatch.from_arrays([pa.array(key), a, b, batch.column(2), batch.column(0)], names=["key", "a", "b", "n", "id"])

    return run


def pieces(batches, most: int = PIECE):
    """Lists of arrays, one for each column: about ``most`` rows that do not split a value of the first column."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [_words(c) if pa.types.is_binary(c.type) else c.to_numpy() for c in batch.columns]
        if n >= most and (new := np.flatnonzero(cols[0] != held[-1][0][-1])).size:
            at = int(new[0])
            held.append([c[:at] for c in cols])
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n, cols = [], 0, [c[at:] for c in cols]
        held.append(cols)
        n += len(cols[0])
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _trie_bits(group: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, int]:
    """As many leading bits of ``word`` as fit beside the group's number, and how many."""
    width = 64 - max(1, int(group[-1]).bit_length())
    return word >> np.uint64(64 - width), width


def _middles(head: np.ndarray, ids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """For each row the row nearest to the bitwise majority of its cluster (numbers in order, without gaps)."""
    start = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    size = np.diff(np.concatenate([start, [len(cluster)]]))
    ones = np.add.reduceat(np.unpackbits(head.view(np.uint8), axis=1), start, axis=0, dtype=np.int64)
    major = np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64)
    far = popcount(head ^ major[cluster]).sum(axis=1)
    return np.lexsort((ids, far, cluster))[start][cluster]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ (x.astype(np.uint64) >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _clusters(likeness: float):
    """Rows (cluster, hub, id, near, n, a, b): each row of a cluster with the middle; ``near`` if it is a candidate of it."""
    most = budget(64 * HEAD, likeness)

    def piece(key, a, b, n, ids):
        head = np.ascontiguousarray(np.stack([a, b], axis=1)).view(np.uint64)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).astype(np.int64)]))
        hub = np.full(len(key), -1)
        cluster = np.zeros(len(key), np.uint64)
        left = np.ones(len(key), bool)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo <= HOT:
                continue
            rows = np.arange(lo, hi)
            while len(rows) > HOT:
                mid = int(_middles(head[rows], ids[rows], np.zeros(len(rows), np.int64))[0])
                near = (popcount(head[rows] ^ head[rows[mid]]).sum(axis=1) <= most) & comparable(n, rows, rows[mid], likeness)
                if near.sum() < len(rows) // 16:
                    break
                hub[rows[near]] = rows[mid]
                left[rows[near]] = False
                rows = rows[~near]
        rows = np.flatnonzero(left)
        if len(rows):
            h, g, size = head[rows], group[rows], n[rows]
            rest, width = _trie_bits(g, h[:, 0])
            label = trie_self_join(g, rest, width, min(most, budget(width, likeness)), lambda u, v: (popcount(h[u] ^ h[v]).sum(axis=1) <= most) & comparable(size, u, v, likeness))
            many = np.flatnonzero(np.bincount(label, minlength=len(rows))[label] > 1)
            if len(many):
                order = many[np.argsort(label[many], kind="stable")]
                at, lab = rows[order], label[order]
                number = np.cumsum(np.concatenate([[0], (lab[1:] != lab[:-1]).astype(np.int64)]))
                hub[at] = at[_middles(head[at], ids[at], number)]
        hot = (np.diff(edge) > HOT)[group]
        out = np.flatnonzero((hub >= 0) | hot)
        mine = hub[out]
        alone = mine < 0
        mine[alone] = out[alone]
        cluster = _mixed(key[out]) ^ np.where(hot[out], np.uint64(0), _mixed(ids[mine] + 1))
        near = (mine != out) & (popcount(head[out] ^ head[mine]).sum(axis=1) <= most) & comparable(n, out, mine, likeness)
        return pa.RecordBatch.from_arrays([pa.array(cluster.view(np.int64)), pa.array(ids[mine]), pa.array(ids[out]), pa.array(near), pa.array(n[out]), pa.array(a[out]), pa.array(b[out])], names=["cluster", "hub", "id", "near", "n", "a", "b"])

    def run(batches):
        for cols in pieces(batches):
            yield piece(*cols)

    return run


def _across(likeness: float, nearest: bool):
    """Rows (hub, id) of candidates in one cluster but in different groups: for each row the nearest, or all.

    Fingerprints come whole, as one column, or as the words of their heads. ``near_copies`` asks for the nearest only, since all are
    as many as pairs.
    """

    def rows_of(hub, ids):
        return pa.RecordBatch.from_arrays([pa.array(hub), pa.array(ids)], names=["hub", "id"])

    def run(batches):
        for cluster, ids, comp, n, *parts in pieces(batches):
            fp = np.ascontiguousarray(parts[0] if parts[0].ndim == 2 else np.stack(parts, axis=1)).view(np.uint64)
            most = budget(64 * fp.shape[1], likeness)
            group = np.cumsum(np.concatenate([[0], (cluster[1:] != cluster[:-1]).astype(np.int64)]))
            rest, width = _trie_bits(group, fp[:, 0])
            best = np.full(len(ids), np.iinfo(np.int64).max)
            for u, v in trie_pairs(group, rest, width, budget(width, likeness), comp):
                far = popcount(fp[u] ^ fp[v]).sum(axis=1)
                ok = (comp[u] != comp[v]) & (far <= most) & comparable(n, u, v, likeness)
                u, v, far = u[ok], v[ok], far[ok]
                if not nearest:
                    yield rows_of(ids[u], ids[v])
                    continue
                np.minimum.at(best, u, (far << 40) | v)
                np.minimum.at(best, v, (far << 40) | u)
            found = np.flatnonzero(best < np.iinfo(np.int64).max)
            if len(found):
                yield rows_of(ids[best[found] & ((1 << 40) - 1)], ids[found])

    return run


def _compare(size: int, likeness: float):
    """Links of rows (hub, salt, first, id, text), sorted so that each hub's own text comes first."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            u, v = [], []
            for hub, salt, first, i, text in zip(*(batch.column(k) for k in range(5)), strict=True):
                hub, salt, i = hub.as_py(), salt.as_py(), i.as_py()
                s = shingle_set(text.as_py() or b"", size)
                if now != (hub, salt):
                    now, held = (hub, salt), []
                if first.as_py() == 0:
                    if not any(np.array_equal(s, h) for h in held):  # texts that share the hub's id
                        held.append(s)
                elif any(alike(h, s, likeness) for h in held):
                    u.append(hub), v.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def verified(docs: DataFrame, pairs: DataFrame, size: int, likeness: float) -> DataFrame:
    """Links (u, v) of the pairs (hub, id) whose sets are alike. ``docs`` has id and text (as bytes)."""
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("salts"))
    salted = pairs.join(many, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    hubs = salted.select("hub", "salt", F.lit(0).alias("first"), F.col("hub").alias("at")).distinct()
    need = cut(hubs.unionByName(salted.select("hub", "salt", F.lit(1).alias("first"), F.col("id").alias("at"))))
    few = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    sent = docs.join(few, docs["id"] == few["at"]).select("hub", "salt", "first", docs["id"], "text")
    sent = sent.repartition(partitions(docs.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "first")
    return cut(sent.mapInArrow(_compare(size, likeness), "u bigint, v bigint"))


class _Bin:
    """The sets that a bin holds, by unit, and which of its groups are joined so far."""

    def __init__(self, likeness: float):
        self.likeness = likeness
        self.rows, self.units, self.number = [], None, {}
        self.label = np.zeros(0, np.int64)
        self.last, self.seen = None, set()

    def repeated(self, i: int, s: np.ndarray) -> bool:
        """Whether the id has come with this set before; ids come in order."""
        if self.last != i:
            self.last, self.seen = i, set()
        known, new = len(self.seen), xxhash.xxh3_128_digest(s.tobytes())
        self.seen.add(new)
        return len(self.seen) == known

    def hold(self, i: int, comp: int, s: np.ndarray, held: list, met: list) -> None:
        if not self.repeated(i, s):
            self.rows.append((i, comp, s, held, met))

    def close(self):
        """Links among what is held."""
        if self.units is not None:
            return
        self.ids = [r[0] for r in self.rows]
        self.comp = np.array([self._group(r[1]) for r in self.rows], np.int64)
        self.size = np.array([len(r[2]) for r in self.rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.words, self.word = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in self.rows)]), return_inverse=True)
        self.flag = np.zeros(len(self.words), bool)
        units = {}
        for k, r in enumerate(self.rows):
            for x in r[3]:
                units.setdefault(x, []).append(k)
        self.units = {x: np.array(ks) for x, ks in units.items()}
        rows, self.rows = self.rows, []
        for k, (i, comp, s, held, met) in enumerate(rows):
            yield from self._links(i, comp, s, [self.units[x][: np.searchsorted(self.units[x], k)] for x in held] + self._met(met))

    def meet(self, i: int, comp: int, s: np.ndarray, met: list):
        """Links of a row with what its units hold."""
        yield from self.close()
        if not self.repeated(i, s):
            yield from self._links(i, comp, s, self._met(met))

    def _met(self, met: list) -> list:
        return [self.units[x] for x in met if x in self.units]

    def _group(self, comp: int) -> int:
        if comp not in self.number:
            self.number[comp] = len(self.label)
            self.label = np.append(self.label, len(self.label))
        return self.number[comp]

    def _links(self, i: int, comp: int, s: np.ndarray, found: list):
        mine, n = self._group(comp), len(s)
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        at = at[self.label[self.comp[at]] != self.label[mine]]
        at = at[np.minimum(self.size[at], n) >= self.likeness * np.maximum(self.size[at], n) - 1e-6]
        if not len(at):
            return
        size = self.size[at]
        of = np.repeat(np.arange(len(at)), size)
        word = self.word[np.repeat(self.start[at] - np.cumsum(size) + size, size) + np.arange(len(of))]
        where = np.minimum(np.searchsorted(self.words, s), max(0, len(self.words) - 1))
        where = where[self.words[where] == s] if len(self.words) else where[:0]
        self.flag[where] = True
        both = np.bincount(of[self.flag[word]], minlength=len(at))
        self.flag[where] = False
        union = size + n - both
        at = at[(both / np.maximum(union, 1) >= self.likeness) | (union == 0)]
        for old, k in zip(*np.unique(self.label[self.comp[at]], return_index=True), strict=True):
            self.label[self.label == old] = self.label[mine]
            yield self.ids[at[k]], i


def _apart(size: int, likeness: float):
    """Links (u, v) between the groups of each bin; a bin's rows come in the order of ``first`` and id."""

    def run(batches):
        now, one = None, _Bin(likeness)
        for batch in batches:
            out = []
            for low, number, first, i, comp, held, met, text in zip(*(batch.column(k) for k in range(8)), strict=True):
                key, i, comp = (low.as_py(), number.as_py()), i.as_py(), comp.as_py()
                if now != key:
                    out += one.close()
                    now, one = key, _Bin(likeness)
                s = shingle_set(text.as_py() or b"", size)
                if first.as_py() == 0:
                    one.hold(i, comp, s, held.as_py(), met.as_py())
                else:
                    out += one.meet(i, comp, s, met.as_py())
            yield _links_of(out)
        yield _links_of(list(one.close()))

    return run


def _links_of(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["u", "v"])


def joined(docs: DataFrame, rows: DataFrame, size: int, likeness: float) -> DataFrame:
    """Links (u, v) that join what is alike in one cluster but in different groups.

    ``rows`` has cluster, id, comp, n and low, the smallest comp of the cluster; ``docs`` has id and text (as bytes). Clusters with one
    ``low`` share bins. A unit is a cluster or a block of one: it holds its share of the rows outside the largest group, and the rest meets them.
    """
    whole, group = Window.partitionBy("cluster"), Window.partitionBy("cluster", "comp")
    rows = rows.withColumn("of", F.struct(F.count(F.lit(1)).over(group).alias("rows"), "comp"))
    rows = rows.withColumn("out", F.col("comp") != F.max("of").over(whole)["comp"])
    rows = rows.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("out"), F.col("n"))).over(whole) / HELD)))
    rows = rows.withColumn("mine", F.when(F.col("out"), F.pmod(F.xxhash64("id"), "blocks")))
    rows = rows.withColumn("block", F.explode(F.sequence(F.coalesce("mine", F.lit(0).cast("long")), F.col("blocks") - 1)))
    units = cut(rows.select("low", "id", "comp", "n", F.xxhash64("cluster", "block").alias("unit"), F.coalesce(F.col("block") == F.col("mine"), F.lit(False)).alias("held")))
    bins = units.groupBy("low").agg(F.ceil(F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)) / HELD).alias("bins"))
    placed = units.join(bins, "low").withColumn("bin", F.pmod(F.xxhash64("unit"), F.greatest(F.lit(1), "bins")))
    need = placed.groupBy("low", "bin", "id").agg(F.min("comp").alias("comp"), F.collect_set(F.when(F.col("held"), F.col("unit"))).alias("held"), F.collect_set(F.when(~F.col("held"), F.col("unit"))).alias("met"))
    need = cut(need.withColumn("first", F.when(F.size("held") > 0, 0).otherwise(1)).withColumnRenamed("id", "at"))
    numbers = need.agg(F.sum(F.size("held") + F.size("met") + 5)).first()[0] or 0
    few = F.broadcast(need) if numbers <= 4 * BROADCAST_ROWS else need
    sent = docs.join(few, docs["id"] == few["at"]).select("low", "bin", "first", docs["id"], "comp", "held", "met", "text")
    sent = sent.repartition(partitions(docs.sparkSession), "low", "bin").sortWithinPartitions("low", "bin", "first", "id")
    return cut(sent.mapInArrow(_apart(size, likeness), "u bigint, v bigint"))


def _unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("hub", "id").alias("low"), F.greatest("hub", "id").alias("high")).distinct()


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of clusters that hold several groups, with their group and the smallest of the cluster's (``comp`` and ``low``)."""
    label = components(links)
    comp = members.select("cluster", "id", "n", "a", "b").distinct().join(label, F.col("id") == F.col("v"), "left").select("cluster", "id", F.coalesce("label", "id").alias("comp"), "n", "a", "b")
    whole = Window.partitionBy("cluster")
    comp = comp.withColumn("low", F.min("comp").over(whole)).withColumn("high", F.max("comp").over(whole))
    return cut(comp.where("low <> high").drop("high"))


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, likeness: float = 0.8) -> DataFrame:
    """Rows (id, component): the smallest id that links reach, itself included."""
    n = partitions(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    signed = cut(docs.mapInArrow(_signatures(shingle), "id bigint, print binary, n bigint, fp binary"))
    sets = cut(signed.groupBy("print").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    named = sets.where("id is not null").select("id", "fp", "n")
    width, keys = layout(sets.count(), likeness)
    sent = named.mapInArrow(_keys(width, keys), "key bigint, a bigint, b bigint, n bigint, id bigint").repartition(n, "key").sortWithinPartitions("key")
    members = cut(sent.mapInArrow(_clusters(likeness), "cluster bigint, hub bigint, id bigint, near boolean, n bigint, a bigint, b bigint"))
    pairs = cut(members.where("near and hub <> id").select("hub", "id").distinct())
    links = verified(docs, pairs, shingle, likeness)
    rows = _unsettled(members, links)
    if rows.limit(1).count():
        rows = rows.drop("low").repartition(n, "cluster").sortWithinPartitions("cluster")
        more = cut(_unordered(rows.mapInArrow(_across(likeness, True), "hub bigint, id bigint")).join(_unordered(pairs), ["low", "high"], "left_anti"))
        links = links.unionByName(verified(docs, more.select(F.col("low").alias("hub"), F.col("high").alias("id")), shingle, likeness))
        rows = _unsettled(members, links)
    if rows.limit(1).count():
        links = links.unionByName(joined(docs, rows, shingle, likeness))
    label = components(links)
    of_set = sets.select(F.col("print").alias("p"), F.col("id").alias("rep")).join(label, F.col("rep") == F.col("v"), "left").select("p", F.coalesce("label", "rep").alias("component"))
    return signed.join(of_set, F.col("print") == F.col("p"), "left").select(F.col("id").alias(id_col), "component")
