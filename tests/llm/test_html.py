"""HTML extraction: parser cases, plain version over the pages, consensus."""

import html
import re

import pyarrow.dataset as ds
import pytest

from spendlens.llm import html_consensus, queries
from spendlens.llm.html_consensus import Page


@pytest.mark.parametrize("source,text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<div>a < b &lt;c&gt; &amp;amp;</div>", "a < b <c> &amp;"),
    ("<p>one<p>two<b>three</b>four<br>five", "one twothreefour five"),
    ("<p>a</p><script>if (a<b) {'</p>'}</script><style>p{}</style><!-- <p>no --><p>b</p>", "a b"),
    ("<body><header>H</header><nav>n</nav><main><header><h1>T</h1></header><p>Body text here</p>"
     "<div id=comments>c</div></main><aside>s</aside><form>f</form><footer>o</footer></body>",
     "T Body text here"),
    ("<div class='cookie-notice'>c</div><article><p>x \n\t y</p><div class=ad>buy</div></article>",
     "x y"),
    ("<p title='a>b'>ok</p>", "ok"), ("<!-- never closed <p>x", ""), ("<div hidden>q</div>r", "r"),
    ("<script>never closed", ""), ("<td>x", "x"), ("</div></p>stray<ul><li>a<li>b</ul>", "stray a b"),
])
def test_page_text(source, text):
    assert Page(source).extract([]) == text


@pytest.mark.parametrize("source,text", [
    ("<body><div class='page has-sidebar'><article><p>Story</p></article><div class=sidebar>s</div>"
     "</div></body>", "Story"),
    ("<div class=no-ads><p>Story</p></div>", "Story"),
    ("<div id=print-area><article>Story</article></div><div class=related>" + "more " * 9 + "</div>",
     "Story"),
    ("<div class=social-page><div class=x>Story of some length</div><div class=share>s</div></div>",
     "Story of some length"),
    ("<article>Story</article><div class=comments><article>" + "comment " * 9
     + "</article></div>", "Story"),
    ("<div class=post>Story</div><div class=comments><p>a reply</p></div>", "Story"),
])
def test_layout_names_do_not_drop_the_article(source, text):
    assert Page(source).extract([]) == text


SIXTY = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize("source,text", [
    (f"<article><h1>T</h1><div class='comment-on-law'>{SIXTY}</div><p>end</p></article>",
     f"T {SIXTY} end"),
    (f"<article><div id='social-history'>{SIXTY}</div></article>", SIXTY),
    (f"<main><section id='search-history'><p>{SIXTY}</p></section></main>", SIXTY),
    (f"<article><p>a</p><div class='notice-of-motion'>{SIXTY}</div><p>b</p></article>", f"a {SIXTY} b"),
    (f"<body><form id=aspnetForm><nav>n</nav><article><p>{SIXTY}</p></article></form></body>", SIXTY),
    (f"<body><form><div class=x><p>{SIXTY}</p></div></form></body>", SIXTY),
    (f"<article><p>{SIXTY}</p><form><p>Your mail</p></form><div class='comment-list'>c</div>"
     "<div id='ad-300x250'>buy</div><div class='post-comments'>d</div>"
     "<div class='related-articles'>r</div></article>", SIXTY),
    (f"<body><div class='site-header'>h</div><div><p>{SIXTY}</p></div></body>", SIXTY),
    ("<body><div><section>" + f"<p>{SIXTY} {SIXTY}</p>" * 3 + "</section><section><p>short end</p>"
     "</section></div></body>", " ".join([f"{SIXTY} {SIXTY}"] * 3) + " short end"),
])
def test_names_of_topics_and_forms_around_the_page_are_kept(source, text):
    assert Page(source).extract([]) == text


def test_a_very_long_page():
    page = "<body><nav>n</nav><article>" + f"<p>{SIXTY}</p>" * 20_000 + "</article></body>"
    assert Page(page).extract([]) == " ".join([SIXTY] * 20_000)


BODY = "word " * 200


@pytest.mark.parametrize("source,text", [
    (f"<body><div id=page><h1>T</h1><div class=text>{BODY}</div></div></body>", f"T {BODY}"),
    (f"<body><div id=page><h1>T</h1><p>Intro</p><div><div class=text><p>{BODY}</p></div></div></div>"
     "</body>", f"T Intro {BODY}"),
    (f"<body><nav>n</nav><div><section class=a>{BODY}</section><section class=b><div>{BODY}</div>"
     f"</section><section class=c><div><p>{BODY}</p></div></section></div></body>", BODY * 3),
    (f"<body><div class=top>t</div><div class=text>{BODY}</div>stray</body>", BODY),
])
def test_whole_article_without_article_element(source, text):
    assert Page(source).extract([]) == text.strip()


def article(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split())
              for x in re.split(r"</?(?:p|h1)>|<br>", body))
    return " ".join(b for b in blocks if b)


def test_op1_equals_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    t = ds.dataset(f"{sf}/pages.parquet").to_table(columns=["page_id", "url", "html"])
    expected = {p: (u, article(h)) for p, u, h in zip(*(c.to_pylist() for c in t.columns))}
    got = queries.op1_html_consensus(spark, sf).collect()
    assert len(got) == len(expected)
    for r in got:
        assert (r["url"], r["text"]) == expected[r["page_id"]] and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("broadcast", [10, 0])
def test_host_paths_overrule_odd_pages(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_consensus, "MAX_BROADCAST_HOSTS", broadcast)
    page = ("<body><div class='top{i}'>{top}</div><div class='post-body p{i}'><p>{text}</p></div>"
            "</body>")
    rows = [(i, f"https://A.example:80/{i}", page.format(i=i, top="t", text=f"story {i} " * 9))
            for i in range(12)]
    # On this page the odd container is longer than the story.
    rows.append((12, "http://u@a.example/x", page.format(i=3, top="noise " * 50, text="short")))
    rows += [(13, None, None), (14, "https://b.example/", ""), (14, "https://b.example/", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows],
                               "page_id long, url string, html string, host string")
    got = sorted((r["page_id"], r["text"]) for r in html_consensus.extract(df).collect())
    expected = [(i, " ".join(["story", str(i)] * 9)) for i in range(12)]
    assert got == [*expected, (12, "short"), (13, ""), (14, ""), (14, "")]
    assert html_consensus.extract(df.limit(0)).count() == 0
