import math
import re
import time
from collections import Counter, defaultdict

import pytest
from cases import plain

from wirefold.llm import bin_packing as B
from wirefold.llm import html_extract as H
from wirefold.llm import lm_score as L

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- c --><div class="ad big">Buy now, it is cheap</div>
<div id="cookie-notice">We use cookies</div><aside>side</aside>{0}<section id="comments"><article class="comment"><p>reader says a lot of things here</p></article></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; x</footer></body></html>"""
ARTICLE = "<article><h1>A  &amp; B</h1><p><b>First &lt;one&gt; of\n the <i>words</i> that make up a text.<br><p>x</p><ul><li>i<li>j</ul><p>Last&nbsp;one, &#233;&am</article>"
TEXT = "A & B\nFirst <one> of the words that make up a text.\nx\ni\nj\nLast one, é&am"


def test_article_without_the_rest():
    assert H.main_text(PAGE.format(ARTICLE)) == TEXT
    assert H.main_text(PAGE.format("<main>" + ARTICLE.replace("article", "div") + "</main>")) == TEXT
    assert H.main_text(PAGE.format(ARTICLE.replace("article", 'div class="post"'))) == TEXT


def test_open_elements_do_not_swallow_the_article():
    assert H.main_text('<body><div class="ad">x' + ARTICLE) == TEXT
    assert H.main_text(PAGE.format(ARTICLE).replace("</footer></body></html>", "")) == TEXT


def test_all_content_is_in_the_region():
    long, short = "<p>" + "several words of prose " * 30 + "</p>", "<p>" + "a few more words here " * 12 + "</p>"
    parts = [" ".join(re.sub("<[^>]+>", " ", x).split()) for x in (long, short)]
    menu = '<div class="menu"><a href="/">Home</a></div>'
    for tag in ("section", "article", "blockquote", "div"):
        page = f"<body>{menu}<div><h1>Heading</h1><{tag}>{long}</{tag}><{tag}>{short}</{tag}></div></body>"
        assert H.main_text(page).split("\n") == ["Heading", *parts]
    assert H.main_text(f"<body>{menu}<article>{long}</article><section>{short}</section></body>").split("\n") == parts
    assert H.main_text(f"<body>{menu}<table><tr><td>{long}</td><td>{short}</td></tr></table></body>").split("\n") == parts
    assert H.main_text(f"<body>{menu}<main><h1>Heading</h1><article>{long}</article></main></body>").split("\n") == ["Heading", parts[0]]
    assert H.main_text(PAGE.format(ARTICLE * 20)) == "\n".join([TEXT] * 20)


def test_piecewise_parsing_equals_whole(monkeypatch):
    whole = H.main_text(PAGE.format(ARTICLE * 20))
    monkeypatch.setattr(H, "PIECE", 7)
    assert H.main_text(PAGE.format(ARTICLE * 20)) == whole


def test_pages_table(spark):
    rows = [(1, "u", PAGE.format(ARTICLE), "old"), (2, None, None, None), (3, "u", "", None), (4, "u", "no markup at all", None), (1, "u", PAGE.format(ARTICLE), "old"),
            (5, "u", "<p>" + "word " * 100_000, None), (6, "u", "<<<>>&&& </p></p> <!-- open", None), (7, "u", "<nav>only a menu</nav>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract_pages(pages)
    assert out.columns == pages.columns
    got = [r.text for r in out.collect()]
    assert got[0] == got[4] == TEXT and got[1] == got[2] == got[7] == "" and got[3] == "no markup at all"
    assert got[5] == ("word " * 100_000).strip() and got[6] is not None
    assert H.extract_pages(pages.limit(0)).collect() == []


def test_names_are_hints_only():
    body = "".join(f"<p>{'several words of prose ' * 20}</p>" for _ in range(4))
    text = "\n".join([("several words of prose " * 20).strip()] * 4)
    for opened in ('<div class="layout has-sidebar">', '<div class="post related-none">', '<div id="social-history">', '<main><div class="dialog">'):
        assert H.main_text(f"<body><nav>menu</nav>{opened}{body}</div></body>") == text
    # A short article next to a long advert, and next to long comments.
    long = "buy this thing, it is good " * 40
    short = "<article><h1>A title</h1><p>One short line.</p></article>"
    assert H.main_text(f"<body><div class='ad'>{long}</div>{short}<div id='comments'><p>{long}</p></div></body>") == "A title\nOne short line."
    assert H.main_text(f"<body><div id='comments'><p>{long}</p></div></body>") == long.strip()  # nothing else is there


def test_a_cluster_of_its_own_stays_outside():
    body = "".join(f"<p>{'several words of prose ' * 20}</p>" for _ in range(4))
    legal = "<p><a>A</a> <a>B</a></p><div class='legal'><p>" + "legal words here " * 30 + "</p></div>"
    for tag in ("article", "div"):
        text = H.main_text(f"<body><{tag}>{body}</{tag}>{legal}</body>")
        assert "legal" not in text and "A B" not in text and text.count("\n") == 3


@pytest.mark.parametrize("n", [50_000])
def test_deep_pages_in_linear_time(n):
    start = time.process_time()
    assert H.main_text("<div>a" * n).count("\n") == n - 1
    assert len(H.main_text("<p>a<li>b</x>" * n)) > n and H.main_text("<ul><li>" * n + "x") == "x"
    assert time.process_time() - start < 60


def generated_page(rng):
    """A page and its main text, both written out by the generator: nothing here parses html."""
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "caf&eacute;", "a&amp;b", "x &lt; y", "na&#239;ve"]
    plain_words = ["lorem", "ipsum", "dolor", "sit", "amet", "caf\u00e9", "a&b", "x < y", "na\u00efve"]

    def prose(n):
        picks = [rng.randrange(len(words)) for _ in range(n)]
        html = rng.choice([" ", "\n", "  \t"]).join(rng.choice(["{}", "<b>{}</b>", "<i>{}</i>", "<a href='#'>{}</a>"] if rng.random() < 0.1 else ["{}"]).format(words[i]) for i in picks)
        return html, " ".join(plain_words[i] for i in picks)

    def block():
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "ul", "pre"])
        if kind == "ul":
            items = [prose(rng.randint(3, 12)) for _ in range(rng.randint(1, 4))]
            return "<ul>" + "".join(f"<li>{h}</li>" for h, _ in items) + "</ul>", [t for _, t in items]
        html, text = prose(rng.randint(2, 6) if kind == "h2" else rng.randint(15, 90))
        return f"<{kind}>{html}</{kind}>", [text]

    blocks = [(lambda x: (f"<h1>{x[0]}</h1>", [x[1]]))(prose(4))] + [block() for _ in range(rng.randint(2, 9))]
    if all(b[0].startswith("<h") for b in blocks):
        blocks.append((lambda x: (f"<p>{x[0]}</p>", [x[1]]))(prose(40)))
    body = "\n".join(b[0] for b in blocks)
    tag, attrs = rng.choice([("article", ""), ("main", ""), ("div", ' class="post"'), ("div", ' class="layout has-sidebar"')])
    junk = ["<script>var p = '<p>no</p>';</script>", "<style>p{}</style>", "<!-- <p>no</p> -->", f"<form><p>{prose(30)[0]}</p><input></form>",
            "<noscript><p>turn it on</p></noscript>", "<div class='share social'><a href='#'>share</a></div>"]
    before = ["<header><h1>Site</h1></header>", f"<nav><ul>{'<li><a href=#>menu</a>' * rng.randint(1, 8)}</ul></nav>", "<div class='ad'>Buy now</div>",
              "<div id='cookie-notice'>We use cookies</div>"]
    after = ["<aside>side words</aside>", "<footer>&copy; 2024 all rights</footer>", "<section id='comments'><p>me too</p><p>so true</p></section>"]

    def some(items):
        return "".join(x for x in items if rng.random() < 0.6)

    html = f"<html><head><title>t</title></head><body>{some(before)}{some(junk)}<{tag}{attrs}>{some(junk[:3])}{body}{some(junk[:3])}</{tag}>{some(junk)}{some(after)}</body></html>"
    return html, "\n".join(t for b in blocks for t in b[1])


def test_pages_equal_what_the_generator_wrote():
    import random

    rng = random.Random(12)
    for _ in range(400):
        html, text = generated_page(rng)
        assert H.main_text(html) == text, html


def check_bins(out, source, cluster, length, capacity):
    placed, bins = Counter(), defaultdict(list)
    for r in out:
        placed[r[0]] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append((r.bin_offset, r.n_tokens, source[r[0]], cluster[r[0]]))
    assert placed == Counter(length) or all(placed[k] == v for k, v in length.items())
    for b in bins.values():
        at = 0
        for start, n, *_ in sorted(b):
            assert start == at
            at += n
        assert at <= capacity
        for i in (2, 3):
            known = [x[i] for x in b if x[i] is not None]
            assert len(known) == len(set(known))
    return bins


def test_packing_holds_everything_without_conflicts(spark):
    rows = [(i, (i * 37) % 150, f"s{i % 3 if i % 2 else 0}", i % 7 if i % 5 else None, "c") for i in range(400)]
    rows += [(1000, 1234, None, None, "c"), (1001, None, "s0", 1, "c"), (1002, 0, None, None, "c"), (1003, -5, "s0", 1, "c"), (1004, 100, "s0", 1, "c")]
    items = spark.createDataFrame(rows, "doc_id long, length long, source string, cluster long, shard string")
    out = B.pack_documents(items, capacity=100, shard_rows=64).collect()
    src, clu = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    check_bins(out, src, clu, {r[0]: max(0, r[1] or 0) for r in rows}, 100)
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, B.pack_documents(items.repartition(7), capacity=100, shard_rows=64).collect()), key=repr)
    assert B.pack_documents(items.limit(0)).collect() == []


def test_best_fit_takes_the_tightest_compatible_bin():
    lengths = [60, 50, 40, 30, 30, 20, 10, 10]
    sources = [0, 1, 2, 0, 1, 0, 2, -1]
    clusters = [-1, 5, -1, 5, -1, -1, -1, -1]
    bins, _ = B.best_fit(lengths, sources, clusters, 100)
    content = []
    for n, s, c, got in zip(lengths, sources, clusters, bins):
        fits = [(100 - sum(x[0] for x in b), i) for i, b in enumerate(content)
                if sum(x[0] for x in b) + n <= 100 and not any((s >= 0 and x[1] == s) or (c >= 0 and x[2] == c) for x in b)]
        want = min(fits)[1] if fits else len(content)
        if want == len(content):
            content.append([])
        content[want].append((n, s, c))
        assert got == want


def test_pack_texts(docs, no_docs):
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in text.items()}
    out = B.pack_texts(docs, capacity=256).collect()
    totals = Counter()
    for r in out:
        totals[r.doc_id] += r.n_tokens
    assert totals[905] == words[905] and totals[904] == 2 and totals[900] == 0
    assert B.pack_texts(no_docs).collect() == []


def test_packing_query_parts_near_copies(spark, docs, tmp_path):
    from wirefold.llm.jaccard_join import jaccard_components
    from wirefold.llm.queries import op5

    rows = docs.where("doc_id < 500").withColumn("source", docs["doc_id"].cast("string"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    cluster = {r.doc_id: r.component_id for r in jaccard_components(rows).collect()}
    assert len(set(cluster.values())) < len(cluster)
    length = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows.collect()}
    out = op5(spark, str(tmp_path)).collect()
    check_bins(out, {k: k for k in length}, cluster, length, 2048)


def brute_scores(rows, order):
    """The definition, n-gram by n-gram."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(k, re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))) for k, t in rows]

    def grams(w):
        return Counter(tuple(w[i:i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    everywhere = Counter()
    for _, w in docs:
        everywhere.update(grams(w))
    total = sum(len(w) for _, w in docs)
    out = []
    for k, w in docs:
        own = grams(w)

        def c(gram):
            return everywhere[gram] - own[gram]

        def score(gram):
            if len(gram) == 1:
                return math.log((c(gram) or 0.5) / max(1, total - len(w)))
            return math.log(c(gram) / c(gram[:-1])) if c(gram) > 0 else math.log(0.4) + score(gram[1:])

        ending = [tuple(w[max(0, i + 1 - order):i + 1]) for i in range(len(w))]
        out.append((k, len(w), sum(len(g) == order and c(g) > 0 for g in ending), sum(map(score, ending))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes, order", [(8 << 20, 3), (900, 3), (8 << 20, 1), (900, 5)])
def test_backoff_scores_equal_brute_force(docs, monkeypatch, block_bytes, order):
    monkeypatch.setattr(L, "BLOCK_BYTES", block_bytes)
    got = sorted((tuple(r) for r in L.backoff_scores(docs, order=order).collect()), key=repr)
    want = brute_scores(plain(docs), order)
    assert sorted(r[:3] for r in got if r[0]) == sorted(r[:3] for r in want if r[0])
    assert sorted(round(r[3], 4) for r in got) == pytest.approx(sorted(r[3] for r in want), abs=1e-3)


def test_backoff_scores_of_empty_and_single_tables(docs, no_docs):
    assert L.backoff_scores(no_docs).collect() == []
    one = L.backoff_scores(docs.where("doc_id = 903")).collect()
    assert [tuple(r)[:3] for r in one] == [(903, 1, 0)] and one[0].log_score == pytest.approx(math.log(0.5))
