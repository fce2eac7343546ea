"""HTML extraction: minimum cuts against all labellings, pages with a known main text."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from keelson.llm import extraction, mincut, oracles

SF = "/root/testdata/sf0.001"
P = "This is a paragraph of the article, with several words in it. It goes on for a while, as articles do."
Q = "Another long paragraph follows here, again with enough words to look like prose. And a second sentence."


def test_minimum_cut_equals_all_labellings():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randint(1, 9)
        unary = [rnd.randint(-12, 12) for _ in range(n)]
        edges = [(a, b, rnd.randint(1, 9)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < .4]
        found = mincut.label(unary, edges)
        every = [list(x) for x in itertools.product([False, True], repeat=n)]
        least = min(mincut.cost_of(x, unary, edges) for x in every)
        assert mincut.cost_of(found, unary, edges) == least
        best = [x for x in every if mincut.cost_of(x, unary, edges) == least]
        assert found == [any(x[k] for x in best) for k in range(n)]         # the largest source side


def test_long_chain_of_undecided_nodes():
    n = 3000
    unary = [4] + [0] * (n - 2) + [-3]
    edges = [(k, k + 1, 5) for k in range(n - 1)]
    assert mincut.label(unary, edges) == [True] * n


def test_page_labels_equal_all_labellings():
    """The labels of small pages without landmarks, against every labelling of their blocks and containers."""
    rnd = random.Random(2)
    texts = [P, Q, "Menu", "<a href=x>Link one</a>", "<a>a</a> <a>b</a>", "Yes.", "12 / 34", "Read this, please."]
    for _ in range(60):
        page = ""
        for _ in range(rnd.randint(1, 3)):
            page += "<div>" + "".join(f"<{t}>{rnd.choice(texts)}</{t}>" for t in rnd.choices(["p", "div", "li", "h2"], k=rnd.randint(1, 3))) + "</div>"
        blocks, parent = extraction.blocks_of(page)
        unary, edges = extraction.graph(blocks, parent, extraction.costs(blocks, extraction.PRIOR))
        if len(unary) > 13:
            continue
        least = min(mincut.cost_of(list(x), unary, edges) for x in itertools.product([False, True], repeat=len(unary)))
        assert mincut.cost_of(mincut.label(unary, edges), unary, edges) == least


PAGES = [
    (f"<article><h1>T &amp; U</h1><p>{P}<br>x<p> a \n\t b&nbsp;c </article>", ["T & U", P + " x", "a b c"]),
    (f"<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><h1>Title</h1><p>{P}</p><p>Be.</p></main><footer>(c)</footer>",
     ["Title", P, "Be."]),
    (f"<div class='page'><div class='sidebar'><p>{Q}</p></div><div id=content><p>{P}</p><p>Ok.</p></div><div class='cookie-notice'>{Q}</div></div>", [P, "Ok."]),
    (f"<article><p>{P}</p><aside><p>{Q}</p></aside><div class=share><a>Share</a></div><p>End.</p><section id=comments><article><p>{Q}</p></article></section></article>",
     [P, "End."]),
    (f"<form><input name=q><label>Search words</label></form><article><p>{P}</p><form><p>{Q}</p><button>Send</button></form></article>", [P]),
    (f"<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div><h2>Head</h2><p>{P}</p><p>{Q}</p></div><div><a href=3>Imprint</a></div>", ["Head", P, Q]),
    (f"<article><script>if (a<b) '</p>'</script><style>p{{}}</style><p>{P}<!-- <p>no</p> --></p><noscript>off</noscript><ul><li>one<li>two</ul>"
     "<table><tr><td>a<td>b<tr><th>c</table></article>", [P, "one", "two", "a", "b", "c"]),
    (f"<div class='Advertisement-box'>{Q}</div><div role=main><p>{P}</p></div><div role='complementary'>{Q}</div>", [P]),
    (f'<article title="a > b"><p class=\'x>y\'>{P}</p><p>1 < 2 &lt;b&gt; &#233;&#x1F600;</p></article>', [P, "1 < 2 <b> é😀"]),
    ("<p>hello", ["hello"]), ("plain text\nwith lines", ["plain text with lines"]), ("", []), ("<nav>menu</nav>", []), ("<a href=x>only a link</a>", []),
    (f"<article><p>{P}</div></b></article></p><p unfinished", [P]), (f"<!-- never closed <article>{P}</article>", []),
]


@pytest.mark.parametrize("page,want", PAGES, ids=range(len(PAGES)))
def test_known_pages(page, want):
    assert extraction.main_blocks(page) == want


def _given():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    return con.execute(oracles.MAIN_TEXT).fetchall(), con.execute("SELECT page_id, url, html FROM pages").fetchall()


def test_classifier_learns_from_landmarks():
    _, rows = _given()
    feats = np.frombuffer(b"".join(extraction._page_features(h) for _, _, h in rows), np.float32).reshape(-1, 1 + extraction.FEATURES)
    w = extraction.train(feats)
    hit = ((feats[:, 1:] @ w > 0) == (feats[:, 0] > 0)).mean()
    assert hit > 0.8                                 # short notices look like short paragraphs
    assert extraction.train(feats[feats[:, 0] > 0]) is extraction.PRIOR
    for page, want in PAGES:
        assert extraction.main_blocks(page, w) == want


def test_query_on_pages_with_hostile_rows(spark):
    want, rows = _given()
    deep = "<div>" * 3000 + f"<p>{P}</p>" + "</div>" * 3000
    wide = "<article>" + f"<p>{P}</p>" * 3000 + "</article>"
    odd = [(None, None, None), (1, "u", ""), (1, "u", ""), (900, "v", wide), (901, "w", deep), (902, None, "<" * 5000), (903, "x", "<a " * 3000)]
    ddl = "page_id long, url string, html string, text string, n_chars long, pick long, features string"
    df = spark.createDataFrame([(*r, "t", 1, 2, "f") for r in rows + odd], ddl)
    out = extraction.extract(df, extraction.fit(df))
    got = [tuple(r) for r in out.select("page_id", "url", "text", "n_chars").collect()]
    made = {(r[0], r[1]): r[2:] for r in got}
    assert len(got) == len(rows) + len(odd)
    assert sorted(r for r in got if r in set(want)) == sorted(want)
    assert made[None, None] == ("", 0) and made[1, "u"] == ("", 0)
    assert made[900, "v"] == ("\n".join([P] * 3000), 3000 * (len(P) + 1) - 1)
    assert made[901, "w"][0] == P and made[902, None][0] == "<" * 5000
    assert out.columns[:2] == ["page_id", "url"] and "pick" in out.columns


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract(df, extraction.fit(df)).collect() == []
