"""Line dedup, URL rules, decontamination, mixing and HTML on small awkward tables."""

import random
import time
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from pitspark.llm import decontaminate, html_text, line_dedup, mixing, url_filter
from pitspark.llm.queries import MIX_WEIGHTS, URL_RULES


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- line dedup

def test_line_dedup_equals_brute_force(spark):
    got = rows(line_dedup.drop_repeated_lines(brute.docs(spark)), "doc_id", "text", "n_lines", "n_removed")
    assert got == Counter(brute.drop_lines(brute.awkward_texts()))


def test_line_dedup_keeps_first_and_merges_overlaps(spark):
    text = "\n".join("abcde")
    out = line_dedup.drop_repeated_lines(brute.docs(spark, [(2, "x\n" + text + "\ny"), (1, text), (3, "a\nb\nz")]))
    got = {r.doc_id: (r.text, r.n_removed) for r in out.collect()}
    assert got == {1: (text, 0), 2: ("x\ny", 5), 3: ("a\nb\nz", 0)}


def test_line_dedup_cuts_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_COPIES", 2, raising=False)
    text = "a\nb\nc\nd"
    table = [(1, text)] * 5 + [(2, "x\n" + text)] * 2 + [(3, "a\nb")] * 2 + [(None, None)] * 3
    got = rows(line_dedup.drop_repeated_lines(brute.docs(spark, table)), "doc_id", "text", "n_lines", "n_removed")
    assert got == Counter(
        {(1, text, 4, 0): 1, (1, "", 4, 4): 4, (2, "x", 5, 4): 1, (2, "", 5, 5): 1, (3, "a\nb", 2, 0): 2, (None, None, 0, 0): 3}
    )


# --- URL rules

URLS = [
    (1, "http://example.org/es/x", "example.org", "/es/x", "example.org/es/", "block"),
    (2, "HTTPS://WWW.Example.ORG/en/12?x=1", "www.example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://a.org", "a.org", "", None, "allow"),
    (4, "http://a.org/", "a.org", "/", "org/", "allow"),
    (5, "http://notorg/", "notorg", "/", None, "allow"),
    (6, "https://x.com/de/1#t", "x.com", "/de/1", "com/de/", "block"),
    (7, "https://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "no scheme.org/es/", "", "", None, "allow"),
    (10, "://com/fr/://", "com", "/fr/://", "com/fr/", "allow"),
    (11, "http://myexample.org/es/", "myexample.org", "/es/", "org/", "allow"),
    (12, "http://É.org/é?q", "É.org", "/é", "org/", "allow"),
    (13, "x\nhttp://a.com/de/\nb", "a.com", "/de/\nb", "com/de/", "block"),
    (None, "http://a.org/x", "a.org", "/x", "org/", "allow"),
]


def test_url_rules(spark):
    table = [(i, u, "h", "r", "d") for i, u, *_ in URLS + URLS[:2] + URLS[:1]]
    pages = spark.createDataFrame(table, "page_id long, url string, host string, rule string, digest string")
    got = rows(url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)), "page_id", "host", "path", "rule", "verdict")
    assert got == Counter((i, *rest) for i, _, *rest in URLS + URLS[:2] + URLS[:1])


def test_url_rules_without_rows_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, URL_RULES)).count() == 0
    none = spark.createDataFrame([], "rule string, verdict string, path_length int, rule_digest string")
    assert rows(url_filter.judge_urls(pages, none), "rule", "verdict") == Counter([(None, "allow")])


# --- decontamination

def items():
    return [
        (1, brute.passage(20, 60)), (2, "one two"), (3, None), (4, "..."), (10, brute.passage(3, 12)),
        (10, brute.passage(3, 12)), (None, brute.passage(21, 10)), (5, "a a a a a a a a a a a a"), (6, "日本語 x"),
    ]


@pytest.mark.parametrize("per_pass", [500_000, 3])
def test_contamination_equals_brute_force(spark, per_pass):
    texts = brute.awkward_texts() + [(30, "a " * 15), (31, "b a " + "A, " * 11 + "c")]
    bench = spark.createDataFrame([(i, t, "w", 1) for i, t in items()], "item_id long, text string, phrase string, term int")
    got = decontaminate.contamination(brute.docs(spark, texts), bench, per_pass=per_pass)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got, *columns) == Counter(brute.contamination(texts, items()))


def test_contamination_with_empty_sides(spark):
    bench = spark.createDataFrame([(i, t) for i, t in items()], "item_id long, text string")
    docs = brute.docs(spark)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    clean = decontaminate.contamination(docs, bench.limit(0))
    assert clean.count() == docs.count() and clean.where("contaminated").count() == 0


def test_clean_documents_stay_with_all_columns(spark):
    docs = brute.docs(spark)
    bench = spark.createDataFrame([(1, brute.passage(20, 60))], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert rows(docs, "doc_id") - rows(kept, "doc_id") == Counter([(17,), (18,)])


def brute_near(texts, bench, window=10, changed=1, slop=2):
    wins = {}
    for item, text in bench:
        w = brute.words(text)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + window]), set()).add(str(item))
    out = {}
    for doc, text in texts:
        w = brute.words(text)
        for win, ids in wins.items():
            want = Counter(win)
            if len(win) > 2 * changed and any(
                sum((want & Counter(w[s:s + len(win) + slop])).values()) >= len(win) - changed for s in range(len(w))
            ):
                out.setdefault(doc, set()).update(ids)
    return {d: sorted(i) for d, i in out.items()}


def test_near_matches_equal_brute_force(spark):
    rng = random.Random(4)
    base = [brute.passage(700 + k, 14).split() for k in range(4)]
    bench = [(k, " ".join(b)) for k, b in enumerate(base)] + [(9, "unheard " + " ".join(base[0][:9])), (10, "one two three"), (11, "a a a a b")]
    texts = [(99, "one two"), (98, "x one two y"), (97, "b a a a"), (96, None), (95, " ".join(base[1]) + " " + " ".join(base[1]))]
    for i in range(60):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(words))
            words = rng.choice([words[:k] + ["new"] + words[k + 1:], words[:k] + ["new"] + words[k:], words[:k] + words[k + 1:],
                                words[:k] + words[k:k + 2][::-1] + words[k + 2:]])
        texts.append((i, " ".join([f"n{rng.randrange(50)}" for _ in range(5)] + words + ["tail"] * 3)))
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: list(r.near_items) for r in decontaminate.near_contamination(brute.docs(spark, texts), table).collect()}
    want = brute_near(texts, bench)
    missed = {(d, i) for d, ids in want.items() for i in ids} - {(d, i) for d, ids in got.items() for i in ids}
    assert all(set(ids) <= set(want.get(d, [])) for d, ids in got.items())  # nothing that is not there
    assert not missed
    assert decontaminate.near_contamination(brute.docs(spark).limit(0), table).count() == 0


# --- mixing

def brute_targets(sizes, share=1.5, epochs=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: MIX_WEIGHTS[i % 3] for i, s in enumerate(names)}
    open_, target = set(names), {}
    while open_:
        left = share * sum(sizes.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing_meets_targets(spark):
    docs = brute.docs(spark, brute.awkward_texts() + [(100 + i, brute.passage(i, 5 + i)) for i in range(60)])
    got = mixing.mix_sources(docs, MIX_WEIGHTS).toPandas()
    assert len(got) == docs.count()
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    sizes = {s: int(got[got.source.isna() if s is None else got.source == s]["size"].sum()) for s in got.source.unique()}
    target = brute_targets(sizes)
    for s, t in target.items():
        mine = got[got.source.isna() if s is None else got.source == s]
        assert abs(mine.target.iloc[0] - t) < 1e-6 and (mine.source_size == sizes[s]).all()
        assert mine.taken.sum() == int(t + 1e-9)
    assert (got.taken <= 2 * got["size"]).all()
    again = mixing.mix_sources(docs.repartition(7), MIX_WEIGHTS)
    assert rows(again, "doc_id", "size", "taken") == Counter(zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got["size"], got.taken))


def test_mixed_documents_have_the_words_taken(spark):
    docs = brute.docs(spark)
    taken = mixing.mix_sources(docs, MIX_WEIGHTS)
    mixed = mixing.mixed_documents(docs, MIX_WEIGHTS)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("source").agg(F.sum(F.size(F.expr("filter(split(text, '[ \\t-\\r]+'), x -> x != '')"))).cast("long").alias("w"))
    want = taken.where("taken > 0").groupBy("source").agg(F.sum("taken").alias("w"))
    assert rows(words, "source", "w") == rows(want, "source", "w")
    assert mixing.mix_sources(docs.limit(0), MIX_WEIGHTS).count() == 0


# --- HTML

LONG = ("long text " * 30).strip()

PAGES = [
    (1, "<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>one <b>two</b>three<br>four<p>five</article><footer>f</footer>", "T & U one twothree four five"),
    (2, None, ""), (3, "", ""), (4, "<script>var a='</p>'</script><style>p{}</style>", ""),
    (5, "<article><p>a</p><aside>b</aside><div class='user-comments'><p>c</p></div><form>d</form><p>e", "a e"),
    (6, "plain  text\n only", "plain text only"),
    (7, "<body><header>Site</header><div class=cookie-notice>We use</div><div><h1>Head</h1><p>" + "long text " * 30
     + "</p><p>x.</p></div><div id=sidebar><a>l</a></div></body>", "Head " + ("long text " * 30).strip() + " x."),
    (8, "<article>" + "<p>w</p>" * 5000 + "</article>", " ".join("w" * 5000)),
] + [
    (20 + k, f"<nav><a>Home</a></nav>{start}<h1>Head</h1><p>{LONG}</p><p>Short.</p>{end}<div class=sidebar><a>l</a></div>",
     f"Head {LONG} Short.")
    for k, (start, end) in enumerate([
        ('<div id="main" class="content has-sidebar">', "</div>"),
        ('<article class="post no-comments">', "</article>"),
        ('<main class="with-sidebar search">', "</main>"),
        ('<div role="main" class="widget">', "</div>"),
        ('<div class="elementor-widget"><div class="elementor-widget-container">', "</div></div>"),
        ('<div class="widget"><div class="share"><a>s</a></div><article>', "</article></div>"),
        ('<div class="post comment-status">', "</div>"),
    ])
] + [
    (50, f"<article><h1>Head</h1><p>{LONG}</p></article><![foo[ x ]]><article><p>Short one.</p></article>", f"Head {LONG} Short one."),
    (51, f"<body><form action=x><div id=page><h1>Head</h1><p>{LONG}</p><input name=q><button>Go</button></div></form></body>", f"Head {LONG}"),
    (52, f"<article><p>{LONG}</p></article><!-- nav <a>menu", LONG), (53, f"<article><p>{LONG}</p></article><![CDATA[ nav", LONG),
    (54, f"<article><p>{LONG}</p></article><?php echo 1", LONG), (55, f"<!DOCTYPE html [x]><article><p>{LONG}</p></article>", LONG),
    (56, f"<article><p>{LONG}</p></article><article><a href=x>More to read</a></article>", LONG),
    (57, f"<main><p>{LONG}</p></main><form class=search><p>Type a few words to find</p></form>", LONG),
    (40, f"<div><h1>Head</h1><p>{LONG}</p></div><div id=comments><article class=comment><p>{LONG}</p></article></div>", f"Head {LONG}"),
]


def test_main_text(spark):
    table = [(i, None if i == 3 else f"u{i}", h, "x", 1) for i, h, _ in PAGES + PAGES[:1]]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, text string, n_blocks int")
    got = html_text.extract_main_text(pages)
    assert rows(got, "page_id", "text", "n_chars") == Counter((i, t, len(t)) for i, _, t in PAGES + PAGES[:1])
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


def mutated(rng, page):
    """The page with pieces cut, repeated and replaced by scraps of markup."""
    scraps = ["<", ">", "<!", "<![", "<!--", "-->", "]]>", "<?", "</", "</p>", "<p>", "<b>", "&", "&#x", "&#99999999999;", "&#xD800;",
              "<script>", "</script>", "<form>", "</form>", "<a ", "='", '"', "<div class='ad'>", "<![CDATA[", "<!ELEMENT ", "\x00", "<textarea>"]
    for _ in range(rng.randint(1, 6)):
        i, j = sorted(rng.randrange(len(page) + 1) for _ in range(2))
        j = min(j, i + rng.randint(0, 40))
        page = page[:i] + rng.choice([rng.choice(scraps), "", page[i:j] * 2]) + page[j:]
    return page


def plain_blocks(html):
    """The words of a page by the same events, with lists walked instead of counts kept."""
    parser = html_text.BlockParser()
    parser.read(html)
    counts = Counter(name for name, *_ in parser.stack)
    assert counts == Counter({k: v for k, v in parser.open.items() if v})
    assert parser.block_at == [i for i, e in enumerate(parser.stack) if e[0] in html_text.BLOCK]
    return parser.blocks


def test_mutated_pages_never_fail():
    rng = random.Random(3)
    pages = [h for _, h, _ in PAGES if h and len(h) < 3000]
    for k in range(10_000):
        page = mutated(rng, pages[k % len(pages)])
        text, n, kept = html_text.main_text(page)
        blocks = plain_blocks(page)
        words = [w for b in blocks for w in "".join(b.parts).split()]
        assert kept <= n and Counter(text.split()) <= Counter(words)


def test_time_grows_with_the_page():
    def seconds(n):
        page = "<i><b>" * n + "</u>" * n + "<div></div>" * n + "<li><div>" + "<b>" * n + "<li></li>" * n + "<div class=ad>x" * n
        start = time.perf_counter()
        html_text.main_text(page + f"<p>{LONG}")
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.05)


def test_a_phrase_of_many_items_in_many_documents(spark):
    shared = brute.passage(5, 10)
    texts = [(i, f"{shared} {brute.passage(50 + i % 3, 10)}") for i in range(40)]
    bench = [(i, shared) for i in range(30)] + [(100 + i, brute.passage(50 + i, 10)) for i in range(2)] + [(200, f"{shared} {brute.passage(50, 10)}")]
    got = decontaminate.contamination(brute.docs(spark, texts), spark.createDataFrame(bench, "item_id long, text string"))
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert rows(got, *columns) == Counter(brute.contamination(texts, bench))


def test_rows_that_share_an_id_spread_over_ranges(spark):
    """A null id and a repeated one with many texts: the mix still meets its targets."""
    texts = [(None, brute.passage(i, 3 + i % 9)) for i in range(150)] + [(7, brute.passage(900 + i, 5)) for i in range(150)] + [(8, "a b c")] * 200
    docs = brute.docs(spark, texts)
    got = mixing.mix_sources(docs, MIX_WEIGHTS).toPandas()
    assert len(got) == len(texts) and (got.taken <= 2 * got["size"]).all()
    got["source"] = got["source"].astype(object).where(got["source"].notna(), "null")
    for _, mine in got.groupby("source"):
        assert mine.taken.sum() == int(mine.target.iloc[0] + 1e-9)
        placed = mine.sort_values("ranked_before")
        nonzero = placed[placed["size"] > 0]
        assert list(nonzero.ranked_before) == [0, *nonzero["size"].cumsum().iloc[:-1]]
    mixed = mixing.mixed_documents(docs, MIX_WEIGHTS)
    assert mixed.columns == docs.columns and mixed.count() >= (got.taken > 0).sum()
