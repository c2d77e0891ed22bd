import json
import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import bpe, chat, decontaminate, exact_digest, html_text, queries, toxicity
from tests.llm import plain

VOCABULARY = queries.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary file")


# Decontamination

ITEMS = [(1, "Alpha beta gamma DELTA é Ünï x1 y-2 the of and the of"), (2, "short item!"), (3, None), (4, "..."), (5, "Alpha beta gamma delta é Ünï x1 y-2 the of"), (6, "one two three four five six seven eight nine ten eleven")]


def test_decontamination_by_brute_force(make, spark, odd):
    rows = odd + [(900, "say: ONE two, three four-five six seven eight nine ten eleven; end"), (901, "a SHORT, item b"), (902, "alpha beta gamma delta é Ünï x1 y 2 the of and the"), (903, "alpha beta gamma delta É Ünï x1 y 2 the of")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontaminate.decontaminate(make(rows), items).collect()
    want = Counter()
    for i, t in rows:
        n, hit, names = plain.hits(t, ITEMS)
        want[i, n, hit, tuple(names)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in out) == want
    kept = decontaminate.drop_contaminated(make(rows), items)
    assert kept.columns == make(rows).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t in rows if not plain.hits(t, ITEMS)[1])


def test_a_large_benchmark_is_joined_by_shuffle(make, spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = [*odd, (950, "alpha " * 20_000 + ITEMS[0][1] + " beta" * 9), (None, ITEMS[0][1]), (951, ITEMS[0][1]), (951, ITEMS[0][1] + " x")]
    want = Counter(map(str, decontaminate.benchmark_hits(make(rows), items).distinct().collect()))
    hits = decontaminate.benchmark_hits(make(rows), items, most=0)
    plan = hits._jdf.queryExecution().optimizedPlan()
    assert "broadcast" not in plan.toString().lower()
    assert Counter(map(str, hits.distinct().collect())) == want and any("950" in w for w in want)


def test_words_do_not_travel_to_a_large_benchmark(make, spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    hits = decontaminate.benchmark_hits(make(odd), items, most=0)
    hits.collect()
    stack, sent = [hits._jdf.queryExecution().optimizedPlan()], []
    while stack:  # what the joins by hash get from the documents
        node = stack.pop()
        kids = [node.children().apply(i) for i in range(node.children().size())]
        stack += kids
        if node.nodeName() == "Join" and "gram_hash" in node.condition().get().toString():
            sent += [x.split("#")[0] for x in kids[0].output().mkString(",").split(",")]
    assert sent and not {"w", "gram", "text"} & set(sent)


def test_empty_benchmarks_and_tables(make, spark, odd):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(make(odd), none).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.drop_contaminated(make(odd), none).count() == len(odd)
    assert decontaminate.decontaminate(make([]), none).count() == 0


# BPE


@needs_vocabulary
def test_bpe_is_that_of_the_library(make, odd):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = [t for _, t in odd] + ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", "naïve  café\r\n\r\n 漢字 😀👩‍👩‍👧", "don't I'LL they've", "\u0000​﻿", " x", "x ", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    library = Tokenizer.from_file(VOCABULARY)
    own = bpe.load(VOCABULARY)
    for t in texts:
        ids = np.frombuffer(own.encode(t or ""), np.uint32).tolist()
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids == want, t
        assert own.decode(own.encode(t or "")) == library.decode(want, skip_special_tokens=False) == (t or "")


@needs_vocabulary
def test_bpe_rows(make, odd):
    out = bpe.bpe_encode(make(odd), VOCABULARY).collect()
    own = bpe.load(VOCABULARY)
    want = Counter((i, len(own.encode(t or "")) // 4, plain.sha(own.encode(t or "")), plain.sha((t or "").encode())) for i, t in odd)
    assert Counter(tuple(r) for r in out) == want
    whole = bpe.bpe_encode(make(odd), VOCABULARY, keep_text=True).collect()
    assert Counter((r.doc_id, r.decoded) for r in whole) == Counter((i, t or "") for i, t in odd)
    assert bpe.bpe_encode(make([]), VOCABULARY).count() == 0


def test_the_cache_is_bounded(monkeypatch):
    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary file")
    monkeypatch.setattr(bpe, "CACHE", 10)
    own = bpe.Bpe(VOCABULARY)
    own.encode(" ".join(f"word{i}" for i in range(200)))
    assert len(own.cache) <= 10


# Exact digests


def canonical(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip()


UNICODE = ["Café au lait", "café  AU\nLAIT ", "ﬁne", "FINE", "Straße", "STRASSE", "ẛ̣", "â̧", "â̧", "Ａbc", "abc", " abc　", "İ", "x y"]


def test_digests_by_brute_force(make, odd):
    rows = [x for x in odd if x[0] is not None] + [(10_000 + i, t) for i, t in enumerate(UNICODE)]
    groups = {r.doc_id: r.group_id for r in exact_digest.exact_groups(make(rows)).collect()}
    first = {}
    for i, t in sorted(dict(rows).items()):
        first.setdefault(canonical(t), i)
    assert groups == {i: first[canonical(t)] for i, t in dict(rows).items()}


def test_edited_fingerprints_by_brute_force(make, odd):
    rows = odd + [(10_000 + i, t) for i, t in enumerate(UNICODE)]
    out = exact_digest.edited_fingerprints(make(rows)).collect()
    texts = dict(sorted(((i, t or "") for i, t in rows if i is not None), key=lambda x: x[0]))
    ids = list(texts)
    want = Counter()
    for i, t in rows:
        t = t or ""
        n = len(t) // 4
        after = texts[ids[(ids.index(i) + 1) % len(ids)]] if i is not None else None
        edited = t[: len(t) - n] + (after or "")[:n]
        want[i, len(t), plain.sha(edited.encode()), float(canonical(t) == canonical(edited)), float(after is not None and canonical(t) == canonical(after))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out) == want
    by_text = {}
    for r, in zip(out):
        if r.doc_id is not None:
            assert by_text.setdefault(canonical(texts[r.doc_id]), r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_no_documents_and_one(make):
    assert exact_digest.edited_fingerprints(make([])).count() == 0
    assert exact_digest.exact_groups(make([])).count() == 0
    r = exact_digest.edited_fingerprints(make([(7, "abcdefgh")])).first()
    assert (r.edited_sha256, r.near_next) == (plain.sha(b"abcdefab"), 1.0)


# Conversations


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for _, r, t in turns)


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"),
        (2, 0, "user", "same"), (2, 1, "assistant", "same"), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
        (4, 0, None, None), (4, 0, None, None), (7, 0, "system", "é" * 5), (None, 0, "user", "lost"), (8, None, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, id string, turns int")
    c = chat.conversations(df).withColumn("pair_id", F.floor(F.col("id") / 2))
    even = F.col("id") % 2 == 0
    out = {r.pair_id: r for r in chat.preference_format(c.where(even), c.where(~even)).collect()}
    assert sorted(out) == [0, 1, 2, 3, 4]
    first = out[0]
    assert (first.n_prompt_turns, first.prompt) == (1, render([(0, "user", "hi")]))
    assert first.rejected == render([(1, "assistant", "no"), (2, "user", "why")])
    assert [first.chosen[s.begin : s.end] for s in first.chosen_spans] == ["yes<|im_end|>"]
    assert [first.rejected[s.begin : s.end] for s in first.rejected_spans] == ["no<|im_end|>"]
    assert (out[1].n_prompt_turns, out[1].chosen, out[1].rejected) == (2, "", "")
    assert (out[2].rejected_id, out[2].rejected, out[2].chosen) == (None, None, render([(0, None, None)] * 2))
    assert (out[3].chosen_id, out[3].prompt, out[3].rejected) == (None, "", render([(0, "system", "é" * 5)]))
    assert chat.preference_format(c.where("id < 0"), c.where("id < 0")).count() == 0


def test_pairs_of_large_ids(spark, tmp_path):
    ids = [2**53 + 2, 2**53 + 3, -2, -1, 2**62, 2**62 + 1]
    spark.createDataFrame([(i, 0, "user", "hi") for i in ids], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.pair_id: (r.chosen_id, r.rejected_id) for r in queries.op4_preference(spark, str(tmp_path)).collect()}
    assert out == {i // 2: (i, i + 1) for i in ids[::2]}


# Pages

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{color:red}</style><script>if (a<b) document.write("<p>no</p>")</script></head><body class="post">
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div id="main"><article><header><h1>The&nbsp;title &amp; more</h1></header>
<p>First <b>bold</b> and <a href="x">linked</a>\n   words<br>after a break</p><p>One.</p><aside>Buy now</aside>
<div class="ad-banner"><p>Advert text here</p></div><form><p>Subscribe to our letter</p><input value="x"></form>
<p class="notice">Please note this.</p><ul><li>point one</li><li>point two &lt;b&gt;</li></ul><!-- hidden <p>no</p> --><p>Last &#233;nd</p></article>
<section id="comments"><p>A reader says that this was a very long and thoughtful article which deserves a comment.</p></section></div>
<div class="sidebar"><p>Related things to read when you have the time for it.</p></div><footer>&copy; all rights</footer></body></html>"""


def test_a_page():
    assert html_text.main_text(PAGE) == "The title & more First bold and linked words after a break One. point one point two <b> Last énd"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<nav><a>x</a></nav>", ""), ("<article><p>open", "open"), ("<article><p>a<script>never closed <p>b</article>", "a"),
        ("<article><p>a <!-- open <p>b</article>", "a"), ("<article><p>1 < 2 and <a href='>'>x</a></p></article>", "1 < 2 and x"), ("<article><p>&nbsp; </p></article>", ""),
        ('<article><div class="article-header"><h1>t</h1></div><p>a</p></article><article class="comment"><p>c</p></article><ol class="commentlist"><li>d</ol>', "t a"),
        ('<main><p>a</p><p hidden>b</p><div style="display: none">c</div><section class="related-links"><p>d</section></main>', "a"),
    ],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_pages_without_an_article():
    body = "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(3))
    page = f"<div><a href=a>Home</a> <a href=b>About</a></div><div><h1>What a headline this is</h1>{body}</div><div><a>Terms</a> <a>Contact</a></div>"
    text = html_text.main_text(page)
    assert text.count("word") == 120 and "Home" not in text and "Terms" not in text


def test_the_tree_fits_its_table():
    x, y = html_text.training_table()
    wrong = sum(html_text.decide(html_text.tree(), row) != label for row, label in zip(x, y, strict=True))
    assert wrong <= 0.05 * len(y)


def test_page_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (None, "<main>é  é</main>", "y")], "page_id int, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "html", "text", "main_text"]
    assert sorted(r.main_text for r in out.collect() if r.page_id != 1) == ["", "é é"]
    assert html_text.extract(df.where("page_id = 9")).count() == 0


# Toxicity


def paths(token, model):
    """Every reading of a token with its cost."""
    ways = [((0, 0), 0.0, "")]
    for options in toxicity.lattice(token):
        new = []
        for (p, q), cost, text in ways:
            for put, extra in options:
                a, b, total = p, q, cost + extra
                for c in put:
                    k = toxicity.INDEX.get(c, 0)
                    if k or b:
                        total -= float(model.log[a, b, k])
                    a, b = (b, k) if k else (0, 0)
                new.append(((a, b), total, text + put))
        ways = new
    return {text: cost - (float(model.log[a, b, 0]) if b else 0.0) for (a, b), cost, text in ways}


def test_viterbi_finds_the_cheapest_of_all_paths(scored):
    model = scored[0].chars
    rng = random.Random(2)
    tokens = ["1d10t", "i.d.i.o.t", "w0rthle$$", "m00r0n1c", "ko!!", "a-1-b", "5cumb4g"] + ["".join(rng.choice("verantilokosa0145!$..- ") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    for token in tokens:
        cost = paths(token, model)
        assert cost[toxicity.viterbi(token, model)] <= min(cost.values()) + 1e-4, token


def corpus():
    rng = random.Random(9)
    parts = ["lo", "re", "mi", "sa", "tu", "ver", "an", "ti", "ko", "el"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))
    common = [word() for _ in range(150)]
    bad = ["idiot", "scumbag", "moronic", "worthless"]
    disguise = {"idiot": ["1d10t", "i d i o t", "idiiiiot", "i.d.i.o.t"], "scumbag": ["5cumb4g", "s-c-u-m-b-a-g"], "moronic": ["m0r0n1c", "moroooonic"], "worthless": ["w0rthle$$", "worthlesssss"]}
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(common) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            w = rng.choice(bad)
            text.insert(rng.randrange(len(text)), rng.choice(disguise[w]) if i > 500 else w)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in [*docs, (9000, None), (9001, ""), (9002, "x " * 30_000)]], "doc_id bigint, text string, label double")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (0, 1)], "doc_id bigint, toxic int")
    scorer = toxicity.fit(df, lab)
    out = {r.doc_id: r.score for r in toxicity.with_scores(df, scorer).collect()}
    return scorer, out, dict(labels)


def test_disguises_are_restored(scored):
    scorer = scored[0]
    for token, want in (("1d10t", "idiot"), ("idiiiiot", "idiot"), ("i.d.i.o.t", "idiot"), ("5cumb4g", "scumbag"), ("m0r0n1c", "moronic"), ("w0rthle$$", "worthless")):
        assert want in toxicity.restored(token, scorer.chars), token
    assert "idiot" in toxicity.doc_words("you are an i d i o t here", scorer.chars, {})
    assert toxicity.restored("plain,", scorer.chars) == ["plain"]


def test_scores_on_documents_that_were_held_out(scored, spark):
    _, out, labels = scored
    held = {r.doc_id for r in spark.createDataFrame([(i,) for i in labels], "doc_id bigint").where(toxicity.held_out("doc_id")).collect()}
    assert 100 < len(held) < 300
    wrong = [i for i in held if (out[i] >= toxicity.THRESHOLD) != bool(labels[i])]
    assert len(wrong) <= 0.02 * len(held)
    assert all(0 <= s <= 1 for s in out.values())
    assert max(out[9000], out[9001], out[9002]) < toxicity.THRESHOLD
    disguised = [i for i, y in labels.items() if y and i > 500]
    assert sum(out[i] >= toxicity.THRESHOLD for i in disguised) >= 0.9 * len(disguised)


def test_without_labels_nothing_is_toxic(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.with_scores(df, toxicity.fit(df, none)).first().score == 0.0
    empty = df.where("doc_id < 0")
    assert toxicity.with_scores(empty, toxicity.fit(empty, none)).count() == 0


def test_json_of_the_vocabulary_is_not_copied():
    files = [p for p in Path(__file__).resolve().parents[2].rglob("*") if p.suffix in (".json", ".tiktoken", ".model") and ".git" not in p.parts]
    assert all("vocab" not in json.loads(p.read_text() or "{}").get("model", {}) for p in files if p.suffix == ".json" and p.stat().st_size > 100_000)
