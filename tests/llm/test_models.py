"""Main text and language model: brute force, gradients and held-out likelihood."""

import itertools
import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from floodspark.llm import extraction, gru, lm
from llm_rows import awkward, prose, table, words

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><header class="site-header"><h1>Site</h1>
<p>Tagline of the site goes here for all to read.</p></header><nav>Home <a href=1>About</a></nav>
<div id="cookie-notice"><p>We use cookies to make this site better for everyone who visits it.</p></div>
<div class="sidebar"><h3>Popular</h3><p>Some long promotional text that goes on and on for more than eighty characters.</p></div>
<main><article><header><h1>Title</h1></header><p>First paragraph &amp; text<b>bold</b>,<br>same&nbsp; block.<p>Short.
<form><label>Mail</label><input name=a><button>Send</button></form><ul><li>Point one<li>Point two</ul>
<div class="advert"><p>Buy this thing now! It is the best thing you can buy in the world, really, do it.</p></div>
<script>var t="</p><p>not text</p>";</script><!-- <p>no</p> --><p>Last one</p></article>
<section class="comments"><h2>Comments</h2><div class="comment"><p>Great article, I enjoyed reading the whole thing, thanks.</p></div></section>
</main><footer>&copy; me &middot; all rights reserved, in every country of the world and beyond it.</footer></body></html>"""


def test_main_text_of_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>Only this paragraph is here, and it is a long one, longer than eighty characters.</p>"),
            (4, "u", "<article><p>Cut off in the middle of a long enough sentence that has been written here &am"), (5, "u", "<nav>menu</nav>"),
            (6, "u", "<article><p>A whole sentence of the article stands here before the tag <p clas"), (6, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extraction.extract(pages).collect())
    text = "Title First paragraph & textbold, same block. Short. Point one Point two Last one"
    rest = {2: "", 3: "", None: rows[3][2][3:-4], 4: rows[4][2][12:], 5: "", 6: rows[6][2][12:-8]}
    want = Counter([(1, "u", text, len(text)), (6, "u", text, len(text)), *[(i, None if i == 2 else "u", t, len(t)) for i, t in rest.items()]])
    assert got == want
    assert extraction.extract(pages.limit(0)).count() == 0


def test_minimum_cut_is_least():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randrange(1, 10)
        terminal = [(rng.choice((0, 1, 2, 3.5)), rng.choice((0, 1, 2, 3.5))) for _ in range(n)]
        ties = [(a, b, rng.choice((0.3, 1, 2))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.3]
        cost = lambda x: sum(t[0] if v else t[1] for t, v in zip(terminal, x)) + sum(w for a, b, w in ties if x[a] != x[b])
        least = min(map(cost, itertools.product((False, True), repeat=n)))
        assert abs(cost(extraction.minimum_cut(terminal, ties)) - least) < 1e-6


def test_deep_pages_take_the_cut_without_recursion():
    page = "<div>" * 3000 + "<p>Some text that is long enough to be prose, with a full stop at the end.</p>" * 300
    assert extraction.main_text(page).count("Some text") == 300


PROSE = "A sentence that is long enough to count as prose for whoever reads it, twice over."


def test_a_wrapper_named_after_its_layout_keeps_its_article():
    for name in ("page with-sidebar", "has-header", "content-sidebar-wrap"):
        assert extraction.main_text(f'<body><div class="{name}"><article><p>{PROSE}</p></article></div></body>') == PROSE
    for name in ("sidebar", "related-posts", "comments"):
        assert extraction.main_text(f'<body><div class="{name}"><article><p>{PROSE}</p></article></div></body>') == ""
    assert extraction.main_text(f'<body><aside><article><p>{PROSE}</p></article></aside></body>') == ""


def test_an_unclosed_quote_ends_its_tag_at_the_bracket():
    assert extraction.main_text(f'<article><p title="foo>{PROSE}</p></article>') == PROSE
    assert extraction.main_text(f"<article><p class='a' title='foo>{PROSE}</p></article>") == PROSE
    assert extraction.main_text(f'<article><p>{PROSE}</p></article><p title="') == PROSE


def test_paths_of_blocks():
    rows = extraction.blocks("<div><p>one<p>two</p><ul><li>three<li><b>four</b></ul></div>five</nope></b>")
    assert [(b.text, b.depth, b.shared) for b in rows] == [("one", 2, 0), ("two", 2, 1), ("three", 3, 1), ("four", 3, 2), ("five", 0, 0)]
    assert rows[0].parent == rows[1].parent != rows[2].parent == rows[3].parent


def test_deep_pages_are_linear():
    page = "<body>" + "".join(f"<div><p>{PROSE} {i}</p></b></i>" for i in range(20_000))
    rows = extraction.blocks(page)
    assert len(rows) == 20_000 and rows[-1].depth == 20_002 and rows[-1].shared == 20_000


def small_model(seed=1, words=12, hidden=5):
    starts = np.array([0, 2, 6, words])
    w = {k: v.astype(np.float64) for k, v in gru.initial(words, 3, hidden, seed).items()}
    return gru.Model(w, starts)


def test_probabilities_sum_to_one():
    model = small_model()
    hs = np.random.default_rng(3).normal(size=(4, 5))
    total = sum(np.exp(model.log_probs(hs, np.full(4, t))) for t in range(13))
    assert np.allclose(total, 1)


def test_state_is_carried_across_windows_and_cleared_between_texts():
    model = small_model()
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 13, n).astype(np.int32) for n in (1, 5, 31, 32, 33, 100, 0, 64)]
    alone = [model.score([t], 0)[0] for t in texts]
    assert np.allclose(model.score(texts, 0), alone, atol=1e-3)
    for t, score in zip(texts, alone):  # one word at a time
        h, logs = np.zeros((1, 5)), 0.0
        model.projected = None
        for word, before in zip(t, [0, *t[:-1]]):
            hs, _, h = model._run(np.array([[before]]), np.zeros((1, 1), bool), h)
            logs += model.log_probs(hs[0], np.array([word]))[0]
        assert abs(logs - score) < 1e-3


def test_gradients_match_differences():
    rng = np.random.default_rng(7)
    x, y = rng.integers(0, 13, (6, 3)), rng.integers(0, 13, (6, 3))
    fresh = np.zeros((6, 3), bool)
    fresh[0], fresh[3, 1] = True, True

    def loss(model):
        hs, _, _ = model._run(x, fresh, np.zeros((3, 5)))
        return -model.log_probs(hs.reshape(-1, 5), y.ravel()).mean()

    before = small_model()
    start = {k: v.copy() for k, v in before.w.items()}
    squares = {k: np.full_like(v, 1e12) for k, v in start.items()}  # steps are then gradients times 1e-6
    before._learn(x, y, fresh, np.zeros((3, 5)), 1.0, squares)
    for name, w in start.items():
        gradient = (w - before.w[name]) * 1e6
        for at in rng.integers(0, w.size, 6):
            model = small_model()
            model.w[name].flat[at] += 1e-4
            up = loss(model)
            model.w[name].flat[at] -= 2e-4
            assert abs((up - loss(model)) / 2e-4 - gradient.flat[at]) < 2e-4, name


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "MODEL_WORDS", 120)
    monkeypatch.setattr(lm, "DICTIONARY", 300)
    rng = random.Random(9)

    def chain(n):  # each word says what follows
        out = [rng.randrange(30)]
        while len(out) < n:
            out.append((out[-1] * 7 + rng.randrange(3)) % 30)
        return " ".join(f"c{k}" for k in out)

    rows = awkward() + [(3000 + i, chain(200) + " " + prose(rng, 5)) for i in range(300)]
    out = lm.score(table(spark, rows)).collect()
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(w for i, t in texts if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in texts:
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(base, 4)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    chains = [r for r in out if r["held_out"] and (r["doc_id"] or 0) >= 3000]
    assert sum(r["score"] for r in chains) > 0.8 * sum(r["base_score"] for r in chains)
    assert all(r["score"] < 0 for r in out)
    assert lm.score(table(spark, [])).count() == 0


def test_held_out_gain_on_given_documents(spark):
    held = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    gain = sum(r["score"] for r in held) - sum(r["base_score"] for r in held)
    assert gain > 3000  # 512 words, 24 classes, 12 units and windows of 16 gave 2,912


def test_words_of_whole_batches():
    rng = random.Random(4)
    signs = [chr(i) for i in range(130)] + list(" \t\n\v\f\r") * 8 + ["\x85", "\xa0", "\u2003", "É", "İ", "\U0001F600"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)] + ["", " ", " a", "a ", "\x1ca\x1d", "A É"]
    found, begin = lm.tokens(pa.array(texts))
    plain = [t.encode().lower().split() + [b""] for t in texts]
    assert found.cast(pa.binary()).to_pylist() == [w for t in plain for w in t]
    assert np.diff(begin).tolist() == [len(t) for t in plain]


def test_scores_do_not_depend_on_pieces(monkeypatch):
    rows = [(i, t or "") for i, t in awkward() if i is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([False] * len(rows)), pa.array([t for _, t in rows])],
                                       names=["doc_id", "held_out", "t"])
    counts = Counter(w for _, t in rows for w in words(t.lower()) + [""]).most_common(200)
    n = np.array([k for _, k in counts])
    starts = gru.classes(n[:120])
    vocab = lm.Vocabulary(pa.array([w for w, _ in counts]), n, int(n.sum()), 200, 50.0, 120)
    shared = SimpleNamespace(value=(vocab, starts, gru.initial(120, len(starts) - 1)))
    run = lambda *parts: pa.Table.from_batches(lm._score(shared, 3.0, 2.0)(iter(parts))).to_pydict()
    whole = run(batch)
    assert whole["doc_id"] == [i for i, _ in rows]
    assert whole["others"] == [[w for w in words(t.lower()) if w not in dict(counts)] for _, t in rows]
    monkeypatch.setattr(lm, "PIECE", 300)
    monkeypatch.setattr(lm, "CHUNK", 700)
    small = run(batch.slice(0, 5), batch.slice(5))
    for name in ("base", "score"):
        assert np.allclose(small.pop(name), whole.pop(name), atol=1e-3, rtol=1e-6)
    assert small == whole


def test_few_lanes_take_longer_windows(monkeypatch):
    """A long text leaves few lanes; 32 steps of them at a time cost more in calls than in sums."""
    model, rng, calls = small_model(), np.random.default_rng(8), []
    texts = [rng.integers(0, 13, n).astype(np.int32) for n in (8000, *rng.integers(0, 200, 60))]
    run = model._run
    monkeypatch.setattr(model, "_run", lambda *a: calls.append(len(a[0])) or run(*a))
    scores = model.score(texts, 0)
    assert sum(calls) == 8000 and len(calls) < 8000 / gru.STEPS / 10
    monkeypatch.setattr(gru, "TOGETHER", 0)
    assert np.allclose(model.score(texts, 0), scores, atol=1e-3)
