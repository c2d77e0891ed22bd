"""Toxicity by noisy-channel deobfuscation.

Disguised words (leetspeak, spacing, repetition) become character lattices: a digit or sign may
stand for letters, a run of one letter for one or two of it, and a separator for nothing or for a
word's end. Viterbi search finds the most likely letters under a character trigram model that is
counted over all documents. The restored words are scored.

The scorer has one weight for each word and each prefix of a word: the smoothed log ratio of the
toxic and the clean training documents that hold it, lowered by its uncertainty. A document's
evidence is its two strongest words; a logistic function maps it to a score. For the fit, each
training document's own counts are left out.

Scale: trigram counts and scoring cover all rows in single scans with map-side sums (the trigram
table has a fixed size). The classifier is fit on at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled
rows, those of smallest id hash; trigram counts, two numbers for each of these rows and the words that speak for toxicity among
them are all that reaches the driver.

Defined results: null text is the empty text and has the score of no evidence; without toxic or
without clean training rows every score is 0; labels that are null or whose id is null are not
used; an id with several labels counts as toxic if one of them says so; texts and tokens are read whole, however long; repeated
rows have the same score; an empty table gives an empty result. Columns of ``docs`` pass untouched, but for one that has the score's name, which the
score replaces.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import cut

#: Parameters: labelled rows that the classifier is fit on, at most.
TOXIC_ROWS, CLEAN_ROWS = 3_000, 6_000
THRESHOLD = 0.7
#: Words that a worker remembers at most.
CACHE = 300_000
#: Characters beyond which a token's words count as written, too.
LONG = 60

#: Letters of the character model: lower-case Latin-1; anything else ends a word (0).
LETTERS = [c for c in map(chr, range(256)) if unicodedata.category(c) == "Ll" and c.lower() == c and c not in "µªº"]
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
K = len(LETTERS) + 1
_CODE = np.zeros(256, np.int32)
for _c, _i in INDEX.items():
    _CODE[ord(_c)] = _i

#: Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i"}
_SIGN = re.compile("[0-9@$!|+€(£¡]")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1")
_SEPARATED = re.compile(r"\S(?:[.\-_*~·,/ ]\S){2,}")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t\n]\S){2,}(?!\S)")
_SEPARATORS = set(".-_*~·,/ \t\n")


def trigram_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows (gram, n): counts of character trigrams over all texts; at most ``K`` cubed rows."""

    def run(batches):
        for batch in batches:
            total = np.zeros(K**3, np.int64)
            held, size = [], 0
            for text in [*batch.column(0), None]:
                if text is not None and text.is_valid:
                    held.append(text.as_py().lower().encode("latin-1", "replace"))
                    size += len(held[-1])
                if size > 1 << 22 or text is None:
                    code = _CODE[np.frombuffer(b"  " + b"  ".join(held) + b"  ", np.uint8)]
                    total += np.bincount((code[:-2] * K + code[1:-1]) * K + code[2:], minlength=K**3)
                    held, size = [], 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    return df.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Log probabilities of a letter after two others, smoothed with shorter contexts."""

    def __init__(self, grams: dict[int, int]):
        n = np.zeros((K, K, K))
        for g, c in grams.items():
            n[g // (K * K), g // K % K, g % K] = c
        n[:, 0, 0] = 0  # between words
        one = n.sum(axis=(0, 1)) + 1.0
        one /= one.sum()
        two = n.sum(axis=0)
        two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
        self.log = np.log((n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each step the strings that it may stand for, with their costs."""
    steps: list[list[tuple[str, float]]] = []
    i, n = 0, len(token)
    while i < n:
        c = token[i]
        j = i
        while j < n and token[j] == c:
            j += 1
        run = j - i
        if c in INDEX:
            options = [(c, 0.0 if run == 1 else 0.7)]
            if run > 1:
                options.append((c + c, 0.0 if run == 2 else 0.7))
            steps.append(options)
        elif c in LEET:
            options = [(x, 1.0) for x in LEET[c]]
            if run > 1:
                options += [(x + x, 1.0) for x in LEET[c]]
            steps.append([*options, (" ", 6.0)])
        elif c in _SEPARATORS:
            steps.append([("", 0.1), (" ", 1.5)])
        else:
            steps.append([(" ", 0.0), ("", 4.0)])
        i = j
    return steps


def viterbi(token: str, model: CharModel) -> str:
    """The most likely letters of ``token``; words are separated by spaces."""
    log = model.log
    best = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []  # by step: where a state came from
    for options in lattice(token):
        new: dict[tuple[int, int], float] = {}
        came: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for (a, b), cost in best.items():
            for put, extra in options:
                p, q, total = a, b, cost + extra
                for c in put:
                    k = INDEX.get(c, 0)
                    if k or q:
                        total -= float(log[p, q, k])
                    p, q = (q, k) if k else (0, 0)
                old = new.get((p, q))
                if old is None or total < old:
                    new[p, q] = total
                    came[p, q] = (a, b), put
        best = new  # the last two letters, so few states whatever the length
        back.append(came)
    state = min((cost - (float(log[a, b, 0]) if b else 0.0), (a, b)) for (a, b), cost in best.items())[1]
    puts = []
    for came in reversed(back):
        state, put = came[state]
        puts.append(put)
    return "".join(reversed(puts))


def disguised(token: str) -> bool:
    """Whether a lower-case token looks like a word in disguise."""
    if len(token) < 3 or not any(c in INDEX for c in token):
        return False
    return bool(_SIGN.search(token) or _RUN.search(token) or _SEPARATED.fullmatch(token))


def restored(token: str, model: CharModel) -> list[str]:
    """Words of one lower-case token: as written if plain, else as the Viterbi search restores them."""
    words = _WORD.findall(token)
    core = token.strip("\"'`.,;:?!()[]{}<>%&*#$@|~^=+-_/\\")
    forms = []
    if core != token and len(token) - len(core) <= 2 and (token[-1:] in "$@!" or token[:1] in "$@!"):
        forms.append(token)
    forms.append(core)
    # a long token may hold plain words beside disguised ones
    out = list(words) if len(core) > LONG or not disguised(core) else []
    for form in forms:
        if disguised(form):
            out += viterbi(form, model).split()
    return out


def features(word: str) -> list[str]:
    """The word as a whole and its prefixes of 3 to 7 letters."""
    return [f"^{word}$", *(f"^{word[:k]}" for k in range(3, min(7, len(word)) + 1))]


def doc_words(text: str, model: CharModel, memo: dict[str, list[str]]) -> set[str]:
    """The distinct restored words of a text."""
    low = text.lower()
    out: set[str] = set()
    for token in set(low.split()):
        words = memo.get(token)
        if words is None:
            if len(memo) >= CACHE:
                memo.clear()
            words = memo[token] = [w for w in restored(token, model) if len(w) > 2]
        out.update(words)
    for m in _SPACED.finditer(low):
        out.update(w for w in viterbi(m[0], model).split() if len(w) > 2)
    return out


def held_out(id_col: str):
    """Whether a row is held out: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scorer:
    """The fitted model; it travels to the executors."""

    def __init__(self, chars: CharModel, weights: dict[str, float], bias: float, slope: tuple[float, float]):
        self.chars, self.weights, self.bias, self.slope = chars, weights, bias, slope
        self.memo: dict[str, list[str]] = {}
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "known": {}}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            get = self.weights.get
            w = self.known[word] = max([get(f, 0.0) for f in features(word)])
        return w

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        best = sorted(map(self.weight, doc_words(text or "", self.chars, self.memo)))[-2:]
        first, second = (best[-1] if best else 0.0), (best[-2] if len(best) > 1 else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope[0] * first + self.slope[1] * second))))


def _weight(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    if pos <= 1:
        return 0.0
    ratio = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    return max(0.0, ratio - 1.5 / math.sqrt(pos))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small penalty; slopes are not negative."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 0.05 * np.r_[0, w[1:]]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, *[0.05] * (x.shape[1] - 1)])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """The bounded sample (id, text, y) of labelled rows that are not held out."""
    known = labels.select(F.col(label_id).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    known = known.groupBy("i").agg(F.max("y").alias("y")).where(~held_out("i"))
    order = [F.xxhash64("i"), F.col("i")]
    some = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    some = cut(some)  # at most TOXIC_ROWS + CLEAN_ROWS short rows, so they may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(some), F.col("id") == F.col("i")).select("id", "text", "y")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Scorer:
    """The scorer for ``docs``, from labels of rows that are not held out."""
    chars = CharModel({r["gram"]: r["n"] for r in trigram_counts(docs, text_col).collect()})  # at most K cubed rows
    rows = cut(training_rows(docs, labels, id_col, text_col, label_id, label_col))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return Scorer(chars, {}, 0.0, (0.0, 0.0))

    def count(batches):
        memo: dict[str, list[str]] = {}
        for pdf in batches:
            pos, neg = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                (pos if y else neg).update({f for w in doc_words(text or "", chars, memo) for f in features(w)})
            keys = list(pos.keys() | neg.keys())
            yield pd.DataFrame({"f": keys, "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]})

    spread = rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * 2)
    counts = spread.mapInPandas(count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1)) - 1.5 / F.sqrt("pos")
    top = counts.where("pos > 1").where(ratio > 0)
    counted = {r["f"]: (r["pos"], r["neg"]) for r in top.collect()}  # words of the bounded sample that two toxic rows hold
    weights = {f: _weight(p, n, n_pos, n_neg) for f, (p, n) in counted.items()}

    def evidence(batches):
        memo: dict[str, list[str]] = {}
        for pdf in batches:
            out = []
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                found = []
                for w in doc_words(text or "", chars, memo):
                    mine = [counted[f] for f in features(w) if f in counted]
                    found.append(max([_weight(p - y, n - (1 - y), n_pos - y, n_neg - (1 - y)) for p, n in mine], default=0.0))
                out.append([*([0.0, 0.0] + sorted(found))[-2:], y])
            yield pd.DataFrame(out, columns=["second", "first", "y"])

    seen = spread.mapInPandas(evidence, "second double, first double, y int").collect()  # one short row for each training row
    seen = np.array([[r["first"], r["second"], r["y"]] for r in seen])
    w = _logistic(seen[:, :2], seen[:, 2])
    return Scorer(chars, weights, float(w[0]), (float(w[1]), float(w[2])))


def with_scores(docs: DataFrame, scorer: Scorer, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))
