"""Each training-data operator against brute force, on edge cases and on empty tables."""

import random
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import additive_index as ann
from foliant.llm import common, decontaminate, html_extract, jaccard_join, langid, packing, resharding, rollup, toxicity
from foliant.llm.queries import QUERIES
from foliant.llm.tokens import BYTE_BPE, WORD_BPE, tokenizer

SYLLABLES = {"en": ["the", "ing", "er", "wh", "th", "an", "ou"], "fr": ["eau", "ç", "é", "oi", "qu", "è", "ai"]}
ITEM = "Which planet of the solar system has the largest number of known moons, and who first counted them?"
EXTRA = "__th long, __d long, __shard int, score double, lang_pred string, node long, n long, kind string, key long, th long, rank int, __k0 string, __text string, part long, length long, ids binary, shard int, component_id long"


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n)) + "."


def corpus():
    rnd = random.Random(3)
    texts = [(i, sentence(rnd, "en" if i % 3 else "fr", rnd.randint(4, 60)), "en" if i % 3 else "fr") for i in range(120)]
    out = [(i, t + (" You utter moron." if i % 6 == 1 else ""), lang) for i, t, lang in texts]
    out += [(200 + k, out[5][1], "en") for k in range(3)]  # copies
    near = sentence(rnd, "en", 80)
    out += [(210 + k, near + " " + "extra " * k, "en") for k in range(4)]
    out += [(220, "x y", "en"), (221, "X  Y", "en"), (222, f"before it {ITEM} after it", "en"), (223, f"some {ITEM.lower().replace('known', 'knovn')} text", "en")]
    out += [(230, sentence(rnd, "en", 9000), "en"), (231, None, None), (232, "", "en"), (233, " \t\n", None), (234, "12 34 !!", "en"), (None, "no id the ing", "en"), (None, None, None), (5, out[5][1], "en"), (240, "ÅNGSTRÖM <|endoftext|> İstanbul 日本 é", "en")]
    return out


CORPUS = corpus()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of edge cases, with extra columns of clashing names."""
    top = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, lang, "s" if i and i % 2 else None, None) for i, t, lang in CORPUS], "doc_id long, text string, lang string, source string, n_chars long")
    for c in EXTRA.split(", "):
        name, kind = c.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind) if kind == "binary" else F.lit("7").cast(kind))
    docs.repartition(3).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, int(bool(t) and "moron" in t)) for i, t, _ in CORPUS if i is not None and i < 200] + [(None, 1, 1), (3, None, None), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"text": F.lit("x"), "lang": F.lit("en"), "score": F.lit("y"), "__k0": F.lit(1)}).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "zqx no such"), (None, "a text without an id that is long enough to be searched for")], "item_id long, text string").withColumns({"doc_id": F.lit("x"), "n_regions": F.lit(1), "__k0": F.lit(1)}).write.parquet(f"{top}/benchmark.parquet")
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 16))
    v[50:60] = v[0]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(500, None, 1), (600, [0.0] * 16, 1), (700, [float("nan")] * 16, 1), (800, [None] + [1.0] * 15, 1), (900, [1.0], 1), (None, [1.0] * 16, 1), (100, [float(x) for x in v[7]], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit(1)).write.parquet(f"{top}/embeddings.parquet")
    spark.createDataFrame([(1, "u", "<article><p>Hi, there</p></article>"), (2, None, None), (None, "w", ""), (3, "x", "<nav>menu</nav>"), (3, "x", "plain &amp; simple")], "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit("n"), "doc_id": F.lit(1)}).write.parquet(f"{top}/pages.parquet")
    return top


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{top}/{t}.parquet")
    return top


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    f = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert f(spark, empty).count() == 0


def count_ids(df, column="doc_id"):
    return sorted(r[0] if r[0] is not None else -1 for r in df.select(column).collect())


IDS = sorted(-1 if i is None else i for i, _, _ in CORPUS)


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5 == 0


def test_toxicity(spark, sf):
    out = QUERIES["op1_toxicity"](spark, sf)
    assert count_ids(out) == IDS
    for r in out.collect():
        assert r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    for i, t, _ in CORPUS:
        if i is not None and i < 200:
            assert got[i]["predicted"] == int("moron" in t), (i, got[i])
            if "moron" in t:
                assert "moron" in t[got[i]["worst_start"] : got[i]["worst_end"]]
    assert got[231]["score"] == got[232]["score"] == 0


def test_noisy_or_matches_its_definition():
    m = toxicity.Model({"^bad$": 3.0}, -4.0)
    score, n, found = m.document("A bad one. Fine day.\nAll good! Bad bad")
    p = lambda z: 1 / (1 + np.exp(-z))
    assert n == 4 and score == pytest.approx(1 - (1 - p(-1.0)) ** 2 * (1 - p(-4.0)) ** 2) and not found and score < 0.5


def test_scores_equal_the_plain_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_sentences"], r["score"]) for r in toxicity.score(docs, model, ["doc_id"]).collect())
    want = []
    for i, t, _ in CORPUS:
        ps = []
        for sentence_ in toxicity.re.split(r"(?<=[.!?])(?![.!?])|\n", t or ""):
            words = set(toxicity.re.findall(r"[^\W_]+", sentence_.lower()))
            if words:
                features = {x for w in words for x in ({f"^{w}$"} | {f"^{w}$"[a : a + n] for n in (4, 5, 6) for a in range(len(w) + 3 - n)}) if x in model.weights}
                ps.append(1 / (1 + np.exp(-(model.bias + sum(model.weights[x] for x in features)))))
        want.append((-1 if i is None else i, len(ps), max((1 - np.prod([1 - p for p in ps[a : a + 32]]) for a in range(max(1, len(ps) - 31))), default=0.0)))
    want.sort()
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)


def test_a_marked_document_has_a_located_sentence():
    rnd = random.Random(5)
    m = toxicity.Model({"^dull$": 2.6, "^vile$": 6.0, "^grim$": 3.4}, -4.0)
    p = lambda s: 1 / (1 + np.exp(4.0 - sum({"dull": 2.6, "vile": 6.0, "grim": 3.4}.get(w, 0) for w in set(s.split()))))
    for _ in range(300):
        own = [" ".join(rnd.choice(("fine", "day", "so", "dull", "grim", "vile") if rnd.random() < 0.3 else ("fine", "day")) for _ in range(4)) for _ in range(rnd.randint(1, 60))]
        score, n, found = m.document(". ".join(own) + ".")
        ps = [p(s) for s in own]
        stretches = [range(a, min(a + 32, len(own))) for a in range(max(1, len(own) - 31))]
        scores = [1 - np.prod([1 - ps[i] for i in r]) for r in stretches]
        assert n == len(own) and score == pytest.approx(max(scores))
        assert bool(found) == (score >= 0.5)
        picked = [i for i, x in enumerate(ps) if any(abs(x - f[2]) < 1e-12 for f in found)]
        assert {i for i, x in enumerate(ps) if x >= 0.5} <= set(picked)
        if score >= 0.5:
            assert max(1 - np.prod([1 - f[2] for f in found]), max(ps)) >= 0.5 - 1e-12


@pytest.mark.parametrize("name", ["content has-sidebar", "layout-no-sidebar", "page with-comments", "widget", "ad"])
def test_a_wrapper_named_like_a_sidebar_keeps_the_article(name):
    prose = "\n".join(f"Paragraph {i} tells, at some length, what happened on that day and why." for i in range(8))
    body = "".join(f"<p>{x}</p>" for x in prose.split("\n"))
    side = "<div class='sidebar'><p>Buy, buy, buy.</p></div>"
    assert html_extract.main_text(f"<body><div class='{name}'>{body}</div></body>") == prose
    assert html_extract.main_text(f"<body><div class='content'>{body}</div>{side}</body>") == prose
    assert html_extract.main_text("<body><div class='sidebar'><a href='x'>One</a> <a href='y'>Two</a></div></body>") == ""


def test_length_alone_is_not_toxic(spark):
    rnd = random.Random(11)
    texts = [(" ".join(sentence(rnd, "en", 8) for _ in range(40)) + (" You utter moron." if i % 4 == 0 else " What an utter delight."), int(i % 4 == 0)) for i in range(80)]
    model = toxicity.fit(texts)
    clean = " ".join([*(sentence(rnd, "en", 4) for _ in range(2000)), "An utter delight."] * 50)
    score, n, found = model.document(clean)
    assert n > 100_000 and score < 0.5 and not found
    score, _, found = model.document(clean + " You utter moron. " + clean)
    assert score >= 0.5 and len(found) == 1
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)] + [(1000 + i, clean[:30_000] + " Zorblax." + " You utter moron." * (i % 2)) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(1000 + i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.training_sample(docs, labels).where("length(text) > 20000").count() > 0
    own = toxicity.train(docs, labels)
    same = toxicity.fit([(r["text"], r["toxic"]) for r in toxicity.training_sample(docs, labels).collect()])
    assert own.weights.keys() == same.weights.keys() and own.bias == pytest.approx(same.bias, abs=1e-3)
    assert own.document(clean)[0] < 0.5 <= own.document(clean + " You utter moron.")[0]


def test_ann_recall_and_exact_scores(spark, sf):
    out = QUERIES["op2_additive_ann"](spark, sf).collect()
    rows = ann.valid(spark.read.parquet(f"{sf}/embeddings.parquet")).collect()
    hit = total = 0
    for q in {r["vec_id"] for r in rows if r["vec_id"] % 100 == 0}:
        own = min(list(r["v"]) for r in rows if r["vec_id"] == q)
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        true = sorted((float(np.sqrt(((np.array(r["v"]) - own) ** 2).sum())), r["vec_id"]) for r in rows if r["vec_id"] != q)
        assert [g[0] for g in got] == list(range(1, 11)) and [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        for _, v, s in got:
            assert any(abs(s - d) < 1e-12 and v == i for d, i in true)
        hit, total = hit + len({i for _, i in true[:10]} & {g[1] for g in got}), total + 10
    assert hit / total >= 0.9 and {r["query_id"] for r in out} == {0, 100, 200, 300}


def test_beam_search_beats_greedy_encoding():
    x = np.random.default_rng(5).normal(size=(300, 8))
    books = ann.fit(x, stages=3, codewords=8)
    rebuilt = lambda codes: sum(books[s][codes[:, s]] for s in range(3))
    wide, norms = ann.encode(x, books, 8)
    narrow, _ = ann.encode(x, books, 1)
    assert ((x - rebuilt(wide)) ** 2).sum() <= ((x - rebuilt(narrow)) ** 2).sum()
    assert np.allclose(norms, (rebuilt(wide) ** 2).sum(1))


def test_least_numbers_of_rows():
    rng = np.random.default_rng(3)
    for m, k in ((256, 8), (2048, 8), (96, 2), (50, 7), (64, 1), (64, 64)):
        cost = rng.integers(0, 300, (40, m)).astype(float)
        at = ann.least(cost, k)
        assert (np.sort(np.take_along_axis(cost, at, 1), 1) == np.sort(cost, 1)[:, :k]).all() and all(len(set(r)) == k for r in at.tolist())


def test_search_in_blocks_equals_one_block(spark, sf):
    rows = ann.valid(spark.read.parquet(f"{sf}/embeddings.parquet"))
    model = ann.train(rows, cells=4)
    index = common.materialise(ann.build(rows, model))
    one, many = (ann.search(index, model, rows.where("vec_id < 40"), block=b).collect() for b in (100, 8))
    assert sorted(one) == sorted(many)


@pytest.mark.parametrize("clusters", [0, 40])
def test_measured_cells_and_margin_keep_the_recall(spark, clusters):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6000, 24))
    if clusters:
        x = 8 * rng.normal(size=(clusters, 24))[rng.integers(0, clusters, 6000)] + x
    df = spark.createDataFrame([(i, [float(y) for y in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    rows = ann.valid(df)
    model = ann.train(rows, sample_rows=2000, cells=32)
    assert model.probes <= 4 if clusters else model.probes > 4  # cells help where there are clusters
    index = common.materialise(ann.build(rows, model))
    got = {}
    for r in ann.search(index, model, rows.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found & set(np.argsort(d)[:10].tolist()))
    assert len(got) == 60 and hit >= 0.9 * 600


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site name</h1></header><nav><a href=/>home</a></nav>
<div class="cookie-banner"><p>We, and our partners, use cookies, of many kinds, here.</p></div><div class="layout"><div class="article-body"><h2>A &quot;title&quot;</h2>
<p>First para, with <b>bold</b>  and&nbsp;space &#8212; yes.<p>Second one, unclosed</p><ul><li>item one<li>item two</ul><script>var x="<p>no</p>"</script><div class="ad">buy, buy, buy</div><blockquote>A quote.</blockquote></div>
<aside><p>Aside, text, with, commas, in it</p></aside></div><section id="comments"><p>Nice, long, comment, with, commas, in, it</p></section><form><p>Your mail?</p></form><footer><p>Foot, note</p></footer></body></html>"""


def test_html(spark, sf):
    assert html_extract.main_text(PAGE) == 'A "title"\nFirst para, with bold and space — yes.\nSecond one, unclosed\nitem one\nitem two\nA quote.'
    out = [tuple(r) for r in QUERIES["op3_html_extract"](spark, sf).collect()]
    assert sorted(out, key=str) == sorted([(1, "u", "Hi, there", 9), (2, None, "", 0), (None, "w", "", 0), (3, "x", "", 0), (3, "x", "plain & simple", 14)], key=str)
    assert html_extract.main_text("<div>" * 20_000 + "deep, text") == "deep, text"
    long = "word, " * 50_000
    assert html_extract.main_text(f"<article><p>{long}</p></article>") == long.strip()
    for broken in ("<", "<p", "a < b", "<!-- x", "<script>x", "</p></div>", "<a href='x>y", "&#xD800;&bogus;"):
        html_extract.main_text(broken)


def page_of(rnd):
    """A page and the text of its article, known since the page is built around it."""
    words = lambda a, b: " ".join(rnd.choice(("time", "water", "x < 5", "a<=b", "stone", "R&D", "went", "far", "and", "some", "of")) for _ in range(rnd.randint(a, b)))
    esc = lambda t: t.replace("&", rnd.choice(("&amp;", "&#38;", "&#x26;"))).replace("<=", rnd.choice(("&lt;=", "<="))).replace(" < ", rnd.choice((" &lt; ", " < ")))
    junk = lambda: rnd.choice((
        "<script>if (a<b) '<p>x</p>'</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", '<div class="ad"><p>Buy, buy, and buy some more.</p></div>', "<form><p>Your mail</p><input></form>",
        '<div class="related-posts"><p>Read, if you like, this too.</p></div>', "<aside><p>By the way, this.</p></aside>", '<div id="cookie-banner">We use cookies.</div>', '<ul class="share"><li><a href=x>Share</a></ul>', '<p hidden>No.</p>',
    ))
    blocks, out = [], []
    for _ in range(rnd.randint(3, 9)):
        t = words(12, 60) + "."
        kind = rnd.choice(("p", "p", "p", "open", "inline", "list", "section", "math", "pre", "quote", "wrapped"))
        if kind == "section":
            name, head = rnd.choice(("related-work", "discussion", "search", "share", "comment-on-method")), words(2, 4)
            blocks.append(f'<section id="{name}"><h2 id="{name}-head">{esc(head)}</h2><p>{esc(t)}</p></section>')
            out += [head, t]
        elif kind == "list":
            items = [words(3, 9) for _ in range(rnd.randint(1, 4))]
            blocks.append("<ul>" + "".join(f"<li>{esc(x)}{rnd.choice(('', '</li>'))}" for x in items) + "</ul>")
            out += items
        else:
            blocks.append({
                "p": f"<p>{esc(t)}</p>", "open": f"<p class='has-ad'>{esc(t)}", "inline": f'<p>{esc(t)} <b title="a>b">bold</b>\n <a href=/x>link</a></p>', "math": f"<p>{esc(t)} <math><mi>x</mi><mo>+</mo><mn>1</mn></math></p>",
                "pre": f"<pre><span class=comment>{esc(t)}</span></pre>", "quote": f"<blockquote>{esc(t)}</blockquote>", "wrapped": f"<div><div class='with-sidebar'><p>{esc(t)}</p></div></div>",
            }[kind])
            out.append(t + {"inline": " bold link", "math": " x+1"}.get(kind, ""))
        if rnd.random() < 0.4:
            blocks.append(junk())
    depth = rnd.randint(0, 9)
    body = "<div>" * depth + "<article>" + "".join(blocks) + "</article>" + "</div>" * depth
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a>" for i in range(9)) + "</ul>"
    html = f"<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav>{menu}</nav>{junk()}{body}{junk()}<div>{menu}</div><footer>Foot, note.</footer></body></html>"
    return (html if rnd.random() < 0.8 else html[: html.index("<footer>") + 4]), "\n".join(" ".join(x.split()) for x in out)


def test_articles_come_out_whole():
    rnd = random.Random(17)
    for _ in range(400):
        html, want = page_of(rnd)
        assert html_extract.main_text(html) == want, html


def test_split_articles_and_broken_tags():
    prose = "".join(f"<p>Part {i} tells, at some length, what happened on that day and why.</p>" for i in range(9))
    lines = prose.replace("</p>", "").split("<p>")[1:]
    for wrap in (("", ""), ("<div>", "</div>"), ("<div><div class=w><div>", "</div></div></div>")):
        page = f"<body><div id=a><div>{prose}</div><h2>Two</h2>{wrap[0]}<div>{prose}</div>{wrap[1]}</div><div><p>Short, other.</p></div></body>"
        assert html_extract.main_text(page).split("\n") == [*lines, "Two", *lines]
    assert html_extract.main_text("<p>If a < b and c > d then</p><p>x < 5</p>") == "If a < b and c > d then\nx < 5"
    assert html_extract.main_text("<p>Seen <svg><title>no</title><path d='M0'/><text>drawn</text></svg></p>") == "Seen\ndrawn"
    assert html_extract.main_text("<p>One <a href='x>two</a> three</p>") == "One two three"
    for cut in ("<a " + 'x="y" ' * 10_000, "<a " + "x='y " * 10_001, "<a " + '"' * 100_001, "<!--" * 10_000, "</script" * 20_000, "<div>" * 20_000 + "x</p>" * 20_000):
        began = time.monotonic()
        html_extract.main_text("<p>Some text" + cut)
        assert time.monotonic() - began < 3


def components(rows, rule):
    sets = [set(jaccard_join.shingles(t, rule.k).tolist()) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and rule.den * len(sets[i] & sets[j]) >= rule.num * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_join(spark, sf):
    got = sorted(map(tuple, QUERIES["op4_jaccard_join"](spark, sf).collect()), key=str)
    assert got == components([(i, t) for i, t, _ in CORPUS], jaccard_join.Rule(3, 90, 100))


def variants(n, seed):
    """Near copies at many distances, which need clusters, blocks and rings."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(60)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(60)] = f"z{rnd.randrange(30)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("rule", [jaccard_join.Rule(3, 90, 100), jaccard_join.Rule(5, 80, 100), jaccard_join.Rule(1, 95, 100)])
def test_jaccard_join_of_one_large_cluster(spark, rule, monkeypatch):
    rows = variants(150, 8)
    monkeypatch.setattr(jaccard_join.verified, "__defaults__", (8,))
    monkeypatch.setattr(jaccard_join.candidate_forest, "__defaults__", (16,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = jaccard_join.linked_documents(df, rule).select("doc_id", "n", "component_id")
    assert sorted(map(tuple, out.collect()), key=str) == components(rows, rule)


def test_sets_of_one_node_are_told_apart(spark, sf, monkeypatch):
    own = jaccard_join.node_of
    monkeypatch.setattr(jaccard_join, "node_of", lambda s: (own(s)[0] % 5 + 1, own(s)[1]))  # as if hashes were short
    got = jaccard_join.linked_documents(spark.read.parquet(f"{sf}/documents.parquet"), jaccard_join.Rule(3, 90, 100)).select("doc_id", "n", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == components([(i, t) for i, t, _ in CORPUS], jaccard_join.Rule(3, 90, 100))


@pytest.fixture()
def many_tasks(spark, monkeypatch):
    """Broadcasts off, and so many partitions that a heavy key stands out."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    rows = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(rows) / sum(rows)


def test_heavy_keys_are_dealt_to_many_tasks(spark, many_tasks, tmp_path):
    spark.range(100_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("node"), "id").write.parquet(f"{tmp_path}/big")
    big = spark.read.parquet(f"{tmp_path}/big")
    small = spark.range(0, 100_000, 3).select(F.col("id").alias("node"), (F.col("id") * 2).alias("v")).union(spark.createDataFrame([(7, 14)], "node long, v long"))
    out = common.spread_join(big, small, "node")
    assert out.count() == 100_000 and out.where("v != node * 2").count() == 0 and largest_share(out) < 0.05
    left = common.spread_join(big, small.where("node != 7"), "node", "left")
    assert left.count() == 100_000 and left.where("v is null").count() == big.where("node = 7").count()
    star = spark.range(1, 60_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(70_000, 70_020).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    got = common.connected_components(star)
    assert got.count() == 59_999 + 20 and set(r[0] for r in got.select("root").distinct().collect()) == {0, 70_000}


def test_many_copies_of_one_text_without_broadcasts(spark, many_tasks):
    texts = spark.range(6_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one text that very many documents have").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" of its own kind"))).alias("text"))
    out = jaccard_join.linked_documents(texts.repartition(8), jaccard_join.Rule(3, 90, 100))
    got = {r["doc_id"]: r["component_id"] for r in out.collect()}
    assert got == {i: 1 if i % 3 else i for i in range(6_000)}


def test_count_bound_is_a_bound():
    rng = np.random.default_rng(2)
    for n in (5, 300, 9000, 70_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.unique(np.append(a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)))
        sizes = np.array([len(a), len(b)])
        v = jaccard_join.counts_of(np.array([jaccard_join.point(a), jaccard_join.point(b)]), sizes)
        assert np.minimum(v[0], v[1]).sum() >= len(np.intersect1d(a, b))


def test_connected_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links = common.Links(500)
    for a, b in edges:
        links.join(a, b)
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: links.find(x) for x in touched if links.find(x) != x}


def test_reshard(spark, sf):
    out = QUERIES["op5_reshard"](spark, sf).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in CORPUS)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2]) for r in out) == want
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in out} == {"bytes"}


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(6)
    for _ in range(30):
        supply = [rnd.randrange(1000) for _ in range(4)]
        capacity = resharding.shares(sum(supply), 6)
        flow = resharding.min_cost_flow(supply, capacity)
        assert sum(a for (i, j), a in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity[:4], strict=True))
        assert [sum(a for (i, _), a in flow.items() if i == k) for k in range(4)] == supply
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4])


def test_reshard_splits_a_hot_text_and_balances(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"), F.repeat(F.lit("y"), (F.col("id") % 90).cast("int")))).alias("text"))
    out = resharding.reshard(resharding.measured(rows))
    sizes = [r[1] for r in out.groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 16 and max(sizes) / min(sizes) < 1.05
    moved = out.where("old_shard != shard").groupBy("key").count().count()
    assert 0 < moved < 13_335


def test_rewrite_touches_only_what_changes(spark, tmp_path):
    old, new = resharding.OLD, resharding.NEW
    base = spark.range(60).select("id", F.lit("mine").alias("shard"), (F.col("id") % 4).cast("int").alias(old))
    assert resharding.manifest(spark, str(tmp_path)) == {}
    resharding.rewrite(base.withColumn(new, F.col(old)), str(tmp_path))
    first = resharding.manifest(spark, str(tmp_path))
    layout = resharding.read_shards(spark, str(tmp_path), old).withColumn(new, F.expr(f"IF({old} = 3 AND id > 30, 4, {old})"))
    second = resharding.rewrite(layout, str(tmp_path))
    assert {s for s in first if first[s] == second.get(s)} == {0, 1, 2}
    got = {(r["id"], r["shard"], r[new]) for r in resharding.read_shards(spark, str(tmp_path)).collect()}
    assert got == {(i, "mine", 4 if i % 4 == 3 and i > 30 else i % 4) for i in range(60)}
    third = resharding.rewrite(resharding.read_shards(spark, str(tmp_path), old).withColumn(new, F.col(old)), str(tmp_path))
    assert third == second


def test_reshard_places_every_copy_of_a_text_together_and_evenly(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = QUERIES["op5_reshard"](spark, "/root/testdata/sf0.01").collect()
    assert len(out) == docs.count()
    homes, sizes, least = {}, {}, 0
    for r in out:
        homes.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        least += r["size"] if r["moved"] else 0
    assert all(len(h) == 1 for h in homes.values()) and max(sizes.values()) < 1.02 * sum(sizes.values()) / 16
    total = sum(sizes.values())
    assert least < 1.1 * (total - 12 * total / 16) + 0.03 * total  # what twelve shards have beyond a sixteenth each


def check_packing(pieces, capacity=4096):
    rows = {}
    for r in pieces:
        rows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rows)


def test_min_slack_packing(spark, sf):
    out = QUERIES["op10_min_slack"](spark, sf).collect()
    coder = tokenizer(WORD_BPE)
    want = []
    for i, t, _ in CORPUS:
        ids = np.array([*coder.lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(-1 if i is None else i, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert sorted((-1 if r[0] is None else r[0], *r[1:5]) for r in out) == sorted(want)
    assert check_packing(out) == -(-sum(w[3] for w in want) // 4096)


@pytest.mark.parametrize("planner", [packing.plan_min_slack, packing.plan_best_fit])
def test_plans_place_every_piece_once(planner):
    rnd = random.Random(9)
    for case in range(40):
        cap = rnd.choice([10, 64, 200])
        histogram = {rnd.randint(1, cap): rnd.randint(1, 50) for _ in range(rnd.randint(0, 20))}
        plan = planner(histogram, cap)
        pieces = []
        for x, c in histogram.items():
            s, o = plan.place(np.full(c, x), np.arange(c))
            pieces += [{"sequence_id": a, "offset": b, "length": x} for a, b in zip(s.tolist(), o.tolist(), strict=True)]
        assert check_packing(pieces, cap) == plan.sequences
        if planner is packing.plan_best_fit:
            assert plan.sequences == plain_best_fit(histogram, cap), case


def plain_best_fit(histogram, cap):
    room = []
    for x in sorted((x for x, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= x
        else:
            room.append(cap - x)
    return len(room)


def test_fullest_subset():
    rnd = random.Random(2)
    for _ in range(100):
        counts = {rnd.randint(1, 30): rnd.randint(1, 3) for _ in range(4)}
        room = rnd.randint(0, 60)
        items = [x for x, c in counts.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for s in map(sum, combinations(items, k)) if s <= room)
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(x * k for x, k in got) == best and all(k <= counts[x] for x, k in got)


def test_ranks_by_shuffle_equal_a_good_packing(spark, sf):
    own = common.materialise(packing.pieces(spark.read.parquet(f"{sf}/documents.parquet"), WORD_BPE, 1))
    a, b = (packing.assign(own, packing.plan_min_slack, broadcast_cells=n).collect() for n in (10**6, 0))
    assert check_packing(a) == check_packing(b) and len(a) == len(b)


def test_packed_matrices_round_trip(spark, sf, tmp_path):
    coder = tokenizer(BYTE_BPE)
    want = {i: [*coder.lib.encode_ordinary(t or ""), 50256] for i, t, _ in CORPUS if i is not None and i != 5}
    placed = common.materialise(packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), packing.plan_best_fit, BYTE_BPE, 50256, with_ids=True))
    rows = packing.packed_rows(placed, pad=50256)
    for r in rows.collect():
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 4096 and r["cu_seqlens"][-1] == r["n_tokens"] and r["position_resets"] == r["cu_seqlens"][:-1] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.unpack(rows).collect()}
    assert {i: got[i] for i in want} == want
    packing.write_matrices(packing.matrices(rows, most=3), f"{tmp_path}/m")
    for made in (spark.read.parquet(f"{tmp_path}/m"), QUERIES["op6_pack_binary"](spark, sf)):
        pieces, sequences = {}, []
        for r in made.collect():
            m = packing.matrix_of(r)
            assert m.shape == tuple(r["shape"]) and len(m) <= 64 and zlib.crc32(m.tobytes()) == r["ids_crc32"] and len(r["sequence_ids"]) == len(m)
            sequences += r["sequence_ids"]
            cell = 0
            for k, n in enumerate(r["row_segments"]):
                cu, resets = r["cu_seqlens"][cell + k : cell + k + n + 1], r["position_resets"][cell : cell + n]
                assert cu[0] == 0 and cu[:-1] == resets and (m[k, cu[-1] :] == 50256).all()
                for j in range(n):
                    pieces.setdefault(r["doc_ids"][cell + j], []).append((r["pieces"][cell + j], m[k, cu[j] : cu[j + 1]].tolist()))
                cell += n
            assert cell == len(r["doc_ids"]) == len(r["pieces"])
        assert {i: [x for _, p in sorted(pieces[i]) for x in p] for i in want} == want and sorted(sequences) == list(range(len(sequences)))


def test_wide_ids_round_trip_and_narrow_ones_never_wrap(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 5")
    end = 70_000  # as if the vocabulary were larger than 65,536
    placed = packing.pack(docs, packing.plan_best_fit, BYTE_BPE, end, with_ids=True, width=4)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.unpack(packing.packed_rows(placed, pad=end, width=4), width=4).collect()}
    coder = tokenizer(BYTE_BPE)
    assert got == {i: [*coder.lib.encode_ordinary(t or ""), end] for i, t, _ in CORPUS if i is not None and i < 5}
    with pytest.raises(ValueError):
        packing.narrow(np.array([1, end], "<u4").tobytes(), 2)
    with pytest.raises(Exception, match="16 bits"):
        packing.pack(docs, packing.plan_best_fit, BYTE_BPE, end, with_ids=True).count()


@pytest.mark.parametrize("size", [230, 600])
def test_partial_quotes_of_a_benchmark_text_are_found(size):
    rnd = random.Random(size)
    item = decontaminate.normal(sentence(rnd, "en", size))[:size].strip()
    patterns = decontaminate.Patterns([(1, item)])
    for a in range(0, len(item) - 120, 7):
        assert patterns.search([b"before it " + item[a : a + 120] + b" after it"]), a
    assert patterns.search([item])[0][2] == 0 and not patterns.search([decontaminate.normal(sentence(rnd, "fr", 400))])


def test_decontamination(spark, sf):
    out = {(r["doc_id"], r["item_id"], r["edits"]) for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert out == {(222, 1, 0), (223, 1, 1)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = decontaminate.decontamination_stage(spark, docs, sf)
    assert kept.columns == docs.columns and count_ids(kept) == [i for i in IDS if i not in (222, 223)]


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(t, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_qgram_filter_loses_nothing():
    rnd = random.Random(3)
    item = bytes(rnd.choice(b"abcdefgh ") for _ in range(120))
    patterns = decontaminate.Patterns([(1, item)])
    for _ in range(60):
        own = bytearray(item)
        for _ in range(rnd.randint(0, 14)):
            i = rnd.randrange(len(own))
            own[i : i + 1] = rnd.choice([b"", b"z", bytes([own[i]]) + b"y"])
        text = bytes(rnd.choice(b"abcdefgh ") for _ in range(rnd.randint(0, 90))) + bytes(own) + b" end"
        found = patterns.search([b"", text])
        true = edits(item, text)
        assert bool(found) == (true <= int(patterns.budget[0]))
        if found:
            assert min(f[2] for f in found) == true and found[0][0] == 1


def bordered(item, text):
    word = lambda c: c.isalnum() or ord(c) > 127
    at = text.find(item)
    while at >= 0:
        if (at == 0 or not (word(text[at - 1]) and word(item[0]))) and (at + len(item) == len(text) or not (word(text[at + len(item)]) and word(item[-1]))):
            return True
        at = text.find(item, at + 1)
    return False


def test_items_of_any_size_equal_brute_force():
    rnd = random.Random(21)
    draw = lambda n: "".join(rnd.choice("abc d.") for _ in range(n))
    for n in range(1, 41):
        item = decontaminate.normal(draw(n)).decode() or "a"
        patterns = decontaminate.Patterns([(7, item.encode())])
        texts = []
        for _ in range(25):
            own = list(item)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = rnd.choice(("", "x", "ab"))
            texts.append(decontaminate.normal(draw(rnd.randint(0, 30)) + rnd.choice(("", " ")) + "".join(own) + rnd.choice(("", " ")) + draw(rnd.randint(0, 30))).decode())
        got = {f[0] for f in patterns.search([t.encode() for t in texts])}
        want = {i for i, t in enumerate(texts) if (bordered(item, t) if len(item) < 16 else edits(item, t) <= int(0.08 * len(item)))}
        assert got == want, (item, [texts[i] for i in got ^ want])


def test_regions_over_piece_borders_count_once():
    rnd = random.Random(4)
    item = decontaminate.normal(sentence(rnd, "en", 60))[:400].strip()
    for raw in (item, item[:139].strip(), b"kw7q", b"peru is far"):
        patterns = decontaminate.Patterns([(1, raw)])
        text = bytearray(decontaminate.normal(sentence(rnd, "fr", 130_000) * 3)[: 2 << 20])
        piece = decontaminate.PIECE
        for border in (piece - len(raw) - 1, piece - 3, piece):  # before, across and after it
            own = bytearray(text)
            spots = [5000, border, piece + 3000, piece + 3000 + len(raw) + 1, len(text) - len(raw) - 3]
            for at in spots:
                own[at - 1 : at + len(raw) + 1] = b" " + raw + b" "
            found = patterns.search([bytes(own)])
            assert sorted((f[3], f[4], f[2]) for f in found) == [(at, at + len(raw), 0) for at in spots]


def test_repetitive_texts_need_little_memory():
    import tracemalloc

    patterns = decontaminate.Patterns([(1, b"-" * 150), (2, b"ab" * 300)])
    tracemalloc.start()
    found = patterns.search([b"-" * 1_000_000, b"ab" * 500_000, b"-" * 80])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[:3] for f in found] == [(0, 1, 0), (1, 2, 0), (2, 1, 0)][: len(found)] and len(found) >= 2 and peak < 1 << 30


def test_blocks_of_the_benchmark_meet_documents_in_one_pass(spark):
    rnd = random.Random(8)
    items = [(i, sentence(rnd, "en", 12)) for i in range(40)] + [(100, "Lima"), (101, "what is the capital of peru")]
    docs = [(i, f"{sentence(rnd, 'fr', 30)} {items[i % 42][1].upper() if i % 2 else ''} {sentence(rnd, 'fr', 9)}") for i in range(90)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(tuple, decontaminate.leaks(d, b, n).collect())) for n in (1 << 20, 300))
    assert one == many and {(r[0], r[1]) for r in one} >= {(i, items[i % 42][0]) for i in range(1, 90, 2)} and all(r[2] == 1 for r in one)
    kept = decontaminate.clean(d, b, 300)
    assert "MapInArrow" in kept._jdf.queryExecution().executedPlan().toString() and kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(r[0] for r in kept.collect()) == sorted({i for i, _ in docs} - {r[0] for r in one})


def test_langid(spark, sf):
    out = QUERIES["op8_langid"](spark, sf).collect()
    assert sorted(-1 if r[0] is None else r[0] for r in out) == IDS
    got = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in CORPUS if i is not None and i < 200)
    assert [got[i]["lang_pred"] for i in (231, 232, 233, 234)] == ["und"] * 4 and got[231]["score"] == 0
    assert all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in out)


def test_only_letters_make_a_language():
    model = langid.PPM({"a": [b"abra"], "b": [b"banana"]})
    for t in ("", "12 ½ ²", "Ⅷ ① _", "٣", "🙂 ½"):
        assert langid.classify(model, [t])[0] == ["und"], t
    for t in ("é", "½a", "日", "ª"):
        assert langid.classify(model, [t])[0] != ["und"], t
    long = "banana ½ " * 200_000  # several pieces
    assert langid.classify(model, [long, ""])[0] == ["b", "und"]


def test_ppm_code_lengths_match_a_plain_tree():
    train = {"a": [b"abracadabra abra", b"cadabra"], "b": [b"banana bandana"]}
    model = langid.PPM(train, order=3)
    for text in (b"abra banana", b"zzz", b"a", b"Bandana!"):
        got = model.code_lengths([text])[0]
        for j, lang in enumerate(model.langs):
            stream = b"".join(b"   " + t for t in train[lang])
            low, total = b"   " + text.lower(), 0.0
            for i in range(3, len(low)):
                for k in range(3, -2, -1):
                    if k < 0:
                        total += 8
                        break
                    context = low[i - k : i]
                    after = [stream[p + k] for p in range(len(stream) - k) if stream[p : p + k] == context]
                    if not after:
                        continue
                    if low[i] in after:
                        total -= np.log2(after.count(low[i]) / (len(after) + len(set(after))))
                        break
                    total -= np.log2(len(set(after)) / (len(after) + len(set(after))))
            assert got[j] == pytest.approx(total, rel=1e-5)


def test_rollup(spark, sf, tmp_path):
    out = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op9_token_counts"](spark, sf).collect()}
    byte, word, want = tokenizer(BYTE_BPE), tokenizer(WORD_BPE), {}
    for i, t, lang in CORPUS:
        for version, n in ((BYTE_BPE, len(byte.lib.encode_ordinary(t or ""))), (WORD_BPE, len(word.lib.encode(t or "", add_special_tokens=False).ids))):
            k = ("s" if i and i % 2 else None, lang, version)
            a = want.get(k, (0, 0, 0))
            want[k] = (a[0] + 1, a[1] + n, a[2] + len((t or "").encode()))
    assert out == want  # a recount of all documents
    r = rollup.Rollup(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "s", "en", "v", 5, 9), (2, "s", "en", "v", 7, 8), (3, None, None, "v", 1, 1)], "doc_id long, source string, lang string, version string, tokens long, bytes long")
    assert r.totals().count() == 0
    assert r.commit("b1", rollup.inserts(rows)) and not r.commit("b1", rollup.inserts(rows))
    r.commit("b2", rollup.deletes(rows.where("doc_id = 3")))
    r.commit("b3", rollup.revisions(rows.where("doc_id = 1"), rows.where("doc_id = 1").withColumn("tokens", F.lit(50).cast("long"))))
    r.commit("b4", rollup.inserts(rows.limit(0)))
    want = [("s", "en", "v", 2, 57, 17)]
    assert list(map(tuple, r.totals().collect())) == want
    r.compact()
    for n in range(3):
        r.commit(f"c{n}", rollup.inserts(rows))
        r.commit(f"d{n}", rollup.deletes(rows))
        r.compact()
    assert len(r._folders("base")) == 2 and not r._folders("batch")
    assert list(map(tuple, r.totals().collect())) == want and r.batches() - {f"{x}{n}" for x in "cd" for n in range(3)} == {"b1", "b2", "b3", "b4"} and not r.commit("b2", rollup.inserts(rows))
    with pytest.raises(ValueError):
        r.commit("../x", rows)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf))
        seen.append(count_ids(docs))
        assert docs.columns == columns or name == "packing"
    toxic = {i for i, t, _ in CORPUS if i is not None and t and "moron" in t}
    letters = sorted(-1 if i is None else i for i, t, _ in CORPUS if t and any(c.isalpha() for c in t))
    assert seen[0] == letters
    assert seen[1] == [i for i in letters if i not in toxic]
    left = [(i, t) for i, t, _ in CORPUS if (-1 if i is None else i) in set(seen[1]) and t and any(c.isalpha() for c in t)]
    keep = {c for _, _, c in components(left, jaccard_join.Rule(5, 80, 100)) if c is not None}
    assert set(seen[2]) - {-1} == keep and len(seen[2]) == len(set(seen[2]))
    assert seen[3] == [i for i in seen[2] if i not in (222, 223)]
    assert sorted(set(seen[4])) == seen[3] and corpus_pipeline.ORACLE_SQL is None
