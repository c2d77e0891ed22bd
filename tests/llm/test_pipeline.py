"""The pipeline against a plain version of its stages."""

from pathlib import Path

import numpy as np
import pytest

from chainloom.llm import queries, toxicity
from tests.conftest import DATA
from tests.llm import plain

corpus_pipeline = pytest.importorskip("corpus_pipeline")
needs_vocabulary = pytest.mark.skipif(not Path(queries.VOCABULARY).exists(), reason="no vocabulary file")


@needs_vocabulary
def test_against_plain_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scorer = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = [(i, t) for i, t in rows if scorer.score(t) < toxicity.THRESHOLD]
    sets = [set(plain.shingles(t, 5)) for _, t in rows]
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    label = plain.closure(len(rows), lambda i, j: share(sets[i], sets[j]) >= corpus_pipeline.LIKENESS)
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    gone = plain.repeated(rows, 20)
    rows = [(i, plain.kept(t, g).decode() if g else t) for (i, t), g in zip(rows, gone, strict=True)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[s : s + 10]) for w in (plain.bench_words(t) for _, t in items) for s in range(len(w) - 9)}
    assert all(len(plain.bench_words(t)) >= 10 for _, t in items)
    clean = lambda w: not any(tuple(w[s : s + 10]) in grams for s in range(len(w) - 9))
    rows = [(i, t) for i, t in rows if clean(plain.bench_words(t))]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.VOCABULARY)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), plain.sha(np.array(ids, "<u4").tobytes()), plain.sha((t or "").encode())))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want
    assert 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert {c: t for c, t in out.dtypes} == dict(docs.dtypes)


def test_odd_rows_pass(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "x" * 50_000, "en", "s", 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
    # null and empty texts are copies of each other, and so are the three rows of one text; a row without an id stays
    assert sorted((r.doc_id or -1) for r in docs.collect()) == [-1, 1, 3, 4]
    empty = docs.where("doc_id > 99")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
    tokens = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, docs.schema), DATA).collect()
    assert sorted(r.n_tokens for r in tokens)[:2] == [0, 0] and len(tokens) == len(rows)
