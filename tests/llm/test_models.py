"""Fitted operators: held-out accuracy, brute-force decoding, edge rows."""

import itertools
import random
from zlib import crc32

import numpy as np
from hypothesis import given, settings, strategies as st

from marketlens.llm import cotrain as C, html_extract as H, toxicity as X


def maximal(full, a, b):
    """All maximal scoring segments by their definition: the best segment, then the same to its left and right."""
    best = max(((sum(full[i:j]), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], best[2]
    return [*maximal(full, a, i), (i, j), *maximal(full, j, b)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=16), st.integers(0, 10**6))
def test_segments_are_all_maximal_ones(signs, seed):
    """Every word scored: hits carry what is above the drift, so that plain sums can be compared. No two sums are equal."""
    r = random.Random(seed)
    full = [r.uniform(0.1, 3) if s else -1.0 for s in signs]
    got = X.segments([(i, s) for i, s in enumerate(full) if s > 0], drift=1.0)
    assert sorted((a, b) for _, a, b in got) == maximal(full, 0, len(full))
    assert all(abs(sum(full[a:b]) - s) < 1e-9 for s, a, b in got)


def test_extreme_value_law():
    """lambda by its equation; K so that segments of clean texts are as many as expected; evidence of one segment is its p-value's."""
    s, p = np.array([2.0, 3.0, -1.0]), np.array([0.05, 0.02, 0.93])
    rate = X._positive_root(s, p)
    assert abs(p @ np.exp(rate * s) - 1) < 1e-9
    m = X.Model(scores={b"x": 1.0}, rate=0.5, scale=0.2)
    assert abs(m.expected(10.0, 100) - 20 * np.exp(-5)) < 1e-12
    assert abs(m.evidence(100, [(14.0, 0, 1)]) - -np.log(1 - np.exp(-m.expected(14.0, 100)))) < 1e-9
    assert m.evidence(100, []) == m.evidence(0, []) == 0
    many = [(14.0, i, i + 1) for i in range(40)]
    assert m.evidence(100, many) > m.evidence(100, many[:13]) > m.evidence(100, many[:1])  # every segment counts


def test_log_odds_of_the_dirichlet_prior(spark):
    docs = [(i, "vile common" if i < 20 else "common plain", int(i < 20)) for i in range(100)]
    d = spark.createDataFrame([(i, f"{t} u{i}v{i} p{i}q{i}", y) for i, t, y in docs], "doc_id long, text string, y int")
    model = X.fit(d.select("doc_id", "text"), d.selectExpr("doc_id", "y AS toxic"))
    own = [(i, y) for i, _, y in docs if crc32(str(i).encode()) % 5]
    n_t, n_c = sum(y for _, y in own), sum(1 - y for _, y in own)
    strength = max(X.PRIOR_LEAST, X.PRIOR_SHARE * (n_t + n_c))
    a, b = n_t + strength * n_t / (n_t + n_c), strength * n_t / (n_t + n_c)  # in all toxic documents and no clean one
    odds, sd = np.log(a / (n_t + strength - a)) - np.log(b / (n_c + strength - b)), np.sqrt(1 / a + 1 / b)
    if odds > X.Z * sd:
        assert abs(model.scores[b"vile"] - (odds - sd)) < 1e-9
    assert b"common" not in model.scores and b"plain" not in model.scores


def test_copies_count_once_and_other_texts_each():
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words) for _ in range(400)) for _ in range(300)]  # the same few words in all
    assert len(set(map(X.sketch, texts))) == 300
    assert X.sketch("A b  c\nd") == X.sketch("a B c d") and X.sketch(None) == X.sketch("") == X.sketch(" ")
    same = sum(X.sketch(t) == X.sketch(t.replace(t.split()[200], "changed", 1)) for t in texts)
    assert same > 250


def test_the_logistic_fit_is_the_minimum_where_classes_are_all_but_apart():
    """Clean documents with evidence up to 6, toxic ones from 7 on: full Newton steps never came back from there."""
    for clean, toxic, n_clean, n_toxic in (((0, 6), (7, 200), 600, 10), ((0, 6), (7, 200), 64_000, 200), ((0, 6), (7, 30, 100, 200), 600, 200), ((0, 6, 9), (7, 30, 200), 64_000, 8000)):
        x = np.array([*clean, *toxic], float)
        y = np.array([0.0] * len(clean) + [1.0] * len(toxic))
        n = np.array([n_clean] + [n_clean // 100] * (len(clean) - 1) + [n_toxic] * len(toxic), float)
        weight, bias = X.logistic(x, y, n)
        p = 1 / (1 + np.exp(-(weight * x + bias)))
        assert abs(n @ (p - y)) < 1e-3 and abs((n * (p - y)) @ x + 1e-2 * weight) < 1e-3
        assert weight > 0 and (p[x > 20] > 0.5).all() and (p[x < 5] < 0.5).all()
        if max(clean) < min(toxic):
            assert ((p >= 0.5) == (y == 1)).all()


def toxic_corpus(n=900):
    r = random.Random(8)
    common, docs, labels = [f"w{i}" for i in range(300)], [], []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(5, 200))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randint(0, len(words)), r.choice(("nasty", "VILE!", "foulmouth" + r.choice("abcdefgh"))))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, y))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs + [(5000, None, "x"), (5001, "", "x"), (None, "nasty nasty", "x")], "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels + [(0, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    model = X.fit(d, lab)
    got = {r["doc_id"]: r for r in X.score_documents(d, model).collect()}
    out = [i for i, _, _ in docs if crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (crc32(str(i).encode()) % 5 == 0) for i, _, _ in docs)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in out]) > 0.98
    assert got[5000]["predicted"] == got[5001]["predicted"] == 0 and got[None]["predicted"] == 1 and not got[None]["held_out"]
    marked = next(i for i in out if labels[i][1] and got[i]["passages"])
    p = got[marked]["passages"][0]
    assert any(w.lower().startswith((b"nasty", b"vile", b"foulmouth")) for w in docs[marked][1].encode().split()[p["first"] : p["end"]])


def test_toxicity_of_long_and_repeated_texts(spark):
    docs, labels = toxic_corpus(300)
    long = ["w1 " * 400_000, "w1 " * 200_000 + "nasty vile! foulmoutha nasty " + "w2 " * 200_000, "x" * 1_000_000, "nasty " * 50_000]
    d = spark.createDataFrame([*docs, *((1000 + i, t, "x") for i, t in enumerate(long)), docs[0], docs[0]], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, labels[0], (1000, 0), (1003, 1)], "doc_id long, toxic int")
    model = X.fit(d, lab)
    got = X.score_documents(d, model).collect()
    assert len(got) == 306 and len({(r["score"], r["predicted"]) for r in got if r["doc_id"] == 0}) == 1
    by = {r["doc_id"]: r["predicted"] for r in got}
    assert by[1003] == 1 and by[1000] == by[1002] == 0
    few = X.fit(d, lab, max_train=100)
    assert few.scores == X.fit(d.repartition(5), lab, max_train=100).scores


def test_words_around_toxic_ones_say_nothing(spark):
    """Words that are only a little commoner in toxic texts become significant with many labels; clean long texts hold them too."""
    r = random.Random(5)
    mild, common, rows = [f"mild{i}" for i in range(150)], [f"w{i}" for i in range(400)], []
    for i in range(2500):
        y = int(r.random() < 0.15)
        words = [r.choice(common) for _ in range(r.randint(100, 400))] + [m for m in mild if r.random() < (0.6 if y else 0.4)]
        r.shuffle(words)
        for _ in range(3 * y):
            words.insert(r.randint(0, len(words)), r.choice(("vile", "nasty", "foul")))
        rows.append((i, " ".join(words), y))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = X.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    got = {x["doc_id"]: x["predicted"] for x in X.score_documents(d, model).collect()}
    out = [(got[i], y) for i, _, y in rows if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in out]) > 0.98 and sum(a for a, b in out if b) > 0.95 * sum(b for _, b in out)


def test_held_out_labels_are_not_used(spark):
    docs, labels = toxic_corpus(300)
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    other = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (X.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int")) for rows in (labels, other))
    assert a.scores == b.scores and a.weight == b.weight


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, 0)]):
        r = X.score_documents(d, X.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int"))).first()
        assert r["predicted"] == 0 and 0 <= r["score"] < 0.5 and r["passages"] == []


def test_viterbi_equals_brute_force():
    r = np.random.default_rng(2)
    chain = H.Chain(["a", "b", "c"])
    chain.weights, chain.step, chain.start = r.normal(size=(4, 2)), r.normal(size=(2, 2)), r.normal(size=2)
    for n in range(1, 8):
        fs = [frozenset(x for x in "abc" if r.random() < 0.5) for _ in range(n)]

        def total(labels, fs=fs):
            return chain.start[labels[0]] + sum(chain.emission(f)[k] for f, k in zip(fs, labels, strict=True)) + sum(chain.step[a, b] for a, b in itertools.pairwise(labels))

        assert abs(total(chain.decode(fs)) - max(map(total, itertools.product((0, 1), repeat=n)))) < 1e-9
    assert chain.decode([]) == []


def test_blocks_and_main_text_of_unseen_layouts():
    chain = H.fit(H.labelled_pages())
    n = wrong = 0
    for html, main in H.labelled_pages(80, seed=1234):
        blocks = H.blocks_of(html)
        assert main <= {t for t, _ in blocks}
        for (t, _), k in zip(blocks, chain.decode([f for _, f in blocks]), strict=True):
            n, wrong = n + 1, wrong + ((t in main) != bool(k))
    assert wrong / n < 0.015
    prose = lambda k: "".join(f"<div>The {w} of the long day was told in many words, and nobody knew why it had to end.</div>" for w in "one two three four five six".split()[:k])
    page = f"<body><div><div><a href='/'>Home</a></div><div><a href='/x'>About us</a></div></div><div>We use cookies, accept them.</div><div class='c3'><div>A headline of the day</div>{prose(6)}</div><div><div>Bob, 2 days ago</div><div>Nice one, reply soon.</div></div><div>&copy; All rights reserved</div></body>"
    blocks = H.blocks_of(page)  # no telling tag or name
    main = [t for (t, _), k in zip(blocks, chain.decode([f for _, f in blocks]), strict=True) if k]
    assert len([t for t in main if t.startswith("The ")]) == 6 and not any(t.startswith(("Home", "About", "We use", "Nice", "©")) for t in main)


def test_gradient_equals_finite_differences():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 2, (3, 5, 4)).astype(float), r.integers(0, 2, (3, 5))
    live = np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0]], bool)
    x, y = x * live[..., None], y * live
    params = [r.normal(size=(4, 2)), r.normal(size=(2, 2)), r.normal(size=2)]
    _, grads = H.likelihood(x, y, live, *params)
    for p, g in zip(params, grads, strict=True):
        for i in np.ndindex(p.shape):
            p[i] += 1e-5
            high = H.likelihood(x, y, live, *params)[0]
            p[i] -= 2e-5
            low = H.likelihood(x, y, live, *params)[0]
            p[i] += 1e-5
            assert abs((high - low) / 2e-5 - g[i]) < 1e-6
    every = [sum(np.exp(sum(x[0, t] @ params[0][:, k] for t, k in enumerate(ls)) + sum(params[1][a, b] for a, b in itertools.pairwise(ls)) + params[2][ls[0]]) for ls in itertools.product((0, 1), repeat=5))]
    own = sum(x[0, t] @ params[0][:, k] for t, k in enumerate(y[0])) + sum(params[1][a, b] for a, b in itertools.pairwise(y[0])) + params[2][y[0, 0]]
    assert abs(H.likelihood(x[:1], y[:1], live[:1], *params)[0] - (own - np.log(every[0]))) < 1e-9


def test_malformed_and_deep_pages_take_linear_time():
    import time

    began = time.time()
    for unit in ("<p x='", "<a ", "<script ", "<!a", '<p a="b>c\' ', "<", "</", "<!--", "<p>a</div>", "&"):
        H.blocks_of(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 40
    assert [t for t, _ in H.blocks_of("<p x='a" * 3 + "<p>tail</p>end > x")][-2:] == ["tail", "end > x"]
    deep = H.blocks_of("<article><p>before</p>" + "<div>" * 3000 + "inner" + "</div>" * 3000 + "<p>after</p></article><math><mi>x</mi></math><noscript>n</noscript><object>o</object><svg><title>s</title></svg>")
    assert [t for t, _ in deep] == ["before", "inner", "after", "x", "n", "o"] and all("in:article" in f for _, f in deep[:3])


def test_blocks_of_bad_markup():
    texts = lambda h: [t for t, _ in H.blocks_of(h)]
    assert texts(None) == texts("") == texts("<script>a<p>b") == texts("<!-- x <p>y") == []
    assert texts("<p>a<b>b</b>c<br>d&amp;&nbsp;e\n\t f<p>g<a title='x>y'>h</a>") == ["abc d& e f", "gh"]
    assert texts("1 < 2 <3 <p x='>unclosed") [0].startswith("1 < 2 <3")
    assert texts("<div>" * 3000 + "deep") == ["deep"]


def test_blocks_deep_in_the_page_have_all_their_ancestors():
    deep = "<div>" * 600 + '<div class="sidebar">' + "in" + "</div>" + "after" + "</div>" * 600 + "end"
    got = [(t, f) for t, f in H.blocks_of('<article class="post">' + deep + "</article>")]
    assert [t for t, _ in got] == ["in", "after", "end"]
    assert "part:side" in got[0][1] and "part:side" not in got[1][1]
    assert all("in:article" in f for _, f in got)
    unclosed = H.blocks_of("<x>" * 100_000 + "<p>a</p>" * 50_000)  # no search over the depth
    assert len(unclosed) == 50_000


def test_extract(spark):
    html = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Some long sentence of the article, with &eacute;.</p></article><footer>&copy; me</footer></body></html>"
    df = spark.createDataFrame([(1, "u", html, "t"), (2, None, None, "t"), (None, "v", "", "t"), (1, "u", html, "t")], "page_id long, url string, html string, text string")
    chain = H.fit(H.labelled_pages(120))
    got = H.extract(df, chain).collect()
    want = "Title here\nSome long sentence of the article, with é."
    pages = [h for h, _ in H.labelled_pages(30, seed=5)]
    for r in H.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").selectExpr("*", "'u' AS url"), chain).collect():
        blocks = H.blocks_of(pages[r["page_id"]])
        assert r["text"] == "\n".join(t for (t, _), k in zip(blocks, chain.decode([f for _, f in blocks]), strict=True) if k) and r["n_chars"] == len(r["text"])
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", want, len(want))] * 2 + [("2", "", 0), ("None", "", 0)]


def quality_corpus(n=600):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.7)
        words = [f"w{r.randint(0, 500)}" for _ in range(r.randint(20, 120))]
        text = " ".join(words) + "." if y else r.choice((" ".join(w + "%%%" for w in words), " ".join([words[0]] * 60), " ".join(words).upper() + "!!"))
        docs.append((i, text, r.choice(("en", "de", None)), "good" if y and r.random() < 0.6 else "any", len(text)))
        if i % 2:
            labels.append((i, y))
    return docs, labels, dict(labels)


def test_cotraining_on_held_out_documents(spark):
    docs, labels, truth = quality_corpus()
    d = spark.createDataFrame([*docs, (9000, None, None, None, None), (None, "a b", "en", "x", 3)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    m = C.measure(d).cache()
    model = C.fit(m, lab)
    got = {r["doc_id"]: r for r in C.classify(m, model).collect()}
    out = [i for i in truth if crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == truth[i] for i in out]) > 0.95 and all(got[i]["held_out"] for i in out)
    assert len(got) == len(docs) + 2 and all(0 <= r["score"] <= 1 and r["kept"] == (r["predicted"] == 1) for r in got.values())


def test_cotraining_without_labels(spark):
    docs, _, _ = quality_corpus(20)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for rows in ([], [(1, 1)]):
        assert C.classify(C.measure(d), C.fit(C.measure(d), spark.createDataFrame(rows, "doc_id long, quality int"))).count() == 20


def views(y, r):
    """Text measures that tell y, and metadata of which one kind does."""
    text = np.stack((y * 4 - 2 + r.normal(0, 0.3, len(y)), np.ones(len(y))), 1).astype(np.float32)
    places = np.array([[r.integers(0, 16), 16 + (2 * r.integers(0, 32) + int(v) if r.random() < 0.8 else r.integers(0, 64)), 80, 128, 152, 176, 200, 203] for v in y])
    return text, places


def test_a_view_teaches_the_other():
    """The metadata view has few labels, but the text view is sure about the pool, whose metadata then shows."""
    r = np.random.default_rng(0)
    y, u = r.integers(0, 2, 150).astype(float), r.integers(0, 2, 4000).astype(float)
    (text, places), pool = views(y, r), C.Rows(list(range(4000)), *views(u, r))
    fresh = r.integers(0, 2, 5000).astype(float)
    _, other = views(fresh, r)
    alone, both = C.cotrain(text, places, y, C.Rows([], *(x[:0] for x in views(u, r)))), C.cotrain(text, places, y, pool)
    hits = lambda m: ((m.meta[other].sum(axis=1) >= 0) == (fresh == 1)).mean()
    assert hits(both) > hits(alone) + 0.05
    assert len(both.given) == C.ROUNDS and not alone.given
    assert all(min(g[v]["labels"]) > 0 for g in both.given for v in ("text", "meta")) and min(both.given[-1]["text"]["weights"]) > 0.3


def test_a_round_equals_brute_force(spark):
    """Ranks, labels and samples of a frame against a sort of all rows."""
    r = np.random.default_rng(1)
    y = r.integers(0, 2, 1500).astype(float)
    text, places = views(y, r)
    models = [r.normal(size=2), r.normal(size=C.META_WIDTH)]
    frame = spark.createDataFrame([(i, t.tolist(), p.tolist()) for i, (t, p) in enumerate(zip(text, places, strict=True))], C.MEASURED).repartition(5)
    memory, stored = C.Rows(list(range(1500)), text, places), C.Stored(frame)
    counts = stored.histogram(models)
    assert counts == memory.histogram(models)
    for v, z in enumerate(C.odds(text, places, models)):
        high, n_high, low, n_low = C.surest(counts[v], 0.1, 0.2)
        bins = np.sort(C.bins_of(z))
        assert n_high == (bins >= high).sum() <= 150 and n_low == (bins <= low).sum() <= 300
        next_high, next_low = bins[bins < high].max(), bins[bins > low].min()
        assert (bins >= next_high).sum() > 150 and (bins <= next_low).sum() > 300  # whole bins, as many as fit
    cuts = [C.surest(c, 0.1, 0.2) for c in counts]
    for most in (10_000, 40):
        key = lambda x: (x[0], x[1], x[2].tolist(), list(x[3]))
        a, b = (sorted(map(key, p.taught(models, cuts, "0:", most))) for p in (memory, stored))
        assert a == b and (most == 40 or len(a) == sum(c[1] + c[3] for c in cuts))
    assert C.surest(C.Counter({3: 10}), 0.5, 0.5)[1::2] == (0, 0)  # all rows alike: nothing is taught


def test_cotraining_edge_rows(spark):
    docs, labels, _ = quality_corpus(200)
    long = ["w1 w2. " * 200_000, "x" * 1_000_000, "\n" * 100_000, "é" * 10]
    rows = [*docs, docs[0], docs[0], *((1000 + i, t, "en", "any", 1) for i, t in enumerate(long)), (None, None, None, None, None)]
    d = spark.createDataFrame([(*x, 0.5, 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, places int")
    m = C.measure(d).cache()
    got = C.classify(m, C.fit(m, spark.createDataFrame([*labels, labels[0]], "doc_id long, quality int"))).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 0}) == 1
    assert all(0 <= r["score"] <= 1 for r in got) and [r["held_out"] for r in got if r["doc_id"] is None] == [False]
