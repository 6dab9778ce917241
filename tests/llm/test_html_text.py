"""Main text: parsing by hand-made pages, extraction by the pages' own article elements and by other layouts."""

import html
import re

import numpy as np
import pytest

from sightline.llm import html_text as ht

PAGES = "/root/testdata/sf0.01/pages.parquet"


def article(page):
    """The article element's paragraphs, read off the markup that all given pages share."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1|h2)>", found[1]) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def weights(spark):
    return ht.train(spark.read.parquet(PAGES))


def test_given_pages(spark):
    pages = spark.read.parquet(PAGES)
    rows = ht.extract(pages).collect()
    assert len(rows) == pages.count()
    exact = [r.text == article(r.html) and r.n_chars == len(r.text) for r in rows]
    assert np.mean(exact) >= 0.99


SENTENCES = [f"This is sentence number {i} of an article that goes on for some time, as they do." for i in range(6)]


@pytest.mark.parametrize("page", [
    "<div id='nav' class=menu><a href=/>Home</a></div><div class='post-content'>{}</div><div class='comment-list'><p>I agree "
    "with this a lot, thank you.</p></div><div class=sidebar><p>Related stories</p></div><div id=footer>Copyright 2020</div>",
    "<nav><ul><li><a href=/>Home<li><a href=/a>About</ul></nav><main>{}<aside>Related: something else</aside><form>Name "
    "<input></form></main><footer><p>Imprint</p></footer>",
    "<header>Site title</header><div class=cookie-notice><p>We use cookies to make this site better for you.</p></div>"
    "<article>{}<div class=advert>Buy this now, it is very cheap today.</div></article>",
])
def test_other_layouts(weights, page):
    body = "".join(f"<p>{s}</p>" for s in SENTENCES)
    assert ht.main_text(page.format(body), weights) == "\n".join(SENTENCES)


def test_blocks():
    got = ht.blocks("<p>a&amp;b&eacute;\n\t c<br>d<p>e <b>f</b>g<script>var x='</p>';</script>h<!-- <p>no --><div>i</div>"
                    "<style>p{}</style><li>j<li><a href='>'>k</a></li>&#x41;&copy <ul><li>l")
    assert [b.text for b in got] == ["a&bé c d", "e fgh", "i", "j", "k", "A©", "l"]
    assert ht.blocks(None) == ht.blocks("") == ht.blocks(" <p> </p>") == []
    assert [b.text for b in ht.blocks("x < y <p>1<2</p> tail <unclosed")] == ["x < y", "1<2", "tail"]
    assert len(ht.blocks("<div>" * 30_000 + "deep")) == 1
    assert len(ht.blocks("<p>x" * 30_000)) == 30_000
    assert ht.blocks("<b>" * 20_000 + "x" + "y&amp;" * 20_000)[0].text.startswith("xy&y&")


@pytest.mark.parametrize("raw", [
    "<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT type='a>b'>if(a<b){c='</p>'}</SCRIPT >", "<script><!-- no end\nif(a<b)</script>",
    "<script>var t=\"it's <a href='\";</script>", "<style>/* a<b ' */ p{}</style>", "<textarea>x <b 'open</textarea>",
    "<iframe><p \"</iframe>", "<noscript><img alt='a></noscript>", "<svg><style>a<b</style></svg>",
    "<template><script>a<b;'</script></template>", "<script>'</scripts>'; i<n</script>", "<script src=x></script>"])
def test_contents_of_raw_elements(raw):
    got = ht.blocks(f"<p>Before {raw}it.</p>{raw}<article><p>First.</p></article>{raw}<p>Last.</p>")
    assert [b.text for b in got] == ["Before it.", "First.", "Last."]
    assert ht.blocks("<p>Before</p><script>a<b <p>no end</p>")[0].text == "Before" and len(ht.blocks("<script>a<b <p>x")) == 0


def test_viterbi_is_the_best_path(weights):
    rng = np.random.default_rng(2)
    width = len(ht.NAMES)
    for _ in range(50):
        rows = [rng.choice(width, 4, replace=False).tolist() for _ in range(6)]
        w = rng.normal(size=width + 4)

        def worth(labels):
            turn = w[width:].reshape(2, 2)
            return sum(w[r].sum() for r, y in zip(rows, labels) if y) + sum(turn[a, b] for a, b in zip(labels, labels[1:]))

        best = max(([int(b) for b in f"{k:06b}"] for k in range(64)), key=worth)
        assert ht.viterbi(rows, w) == best


def test_awkward_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (3, "<article><p>Only this text is here.</p></article>"), (4, "plain"), (5, "x " * 100_000)]
    pages = spark.createDataFrame([(*r, "u", 5) for r in rows], "page_id long, html string, url string, text int")
    got = ht.extract(pages).collect()
    assert len(got) == 6 and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert all(r.text == "" for r in got if not r.html)
    assert ht.extract(pages.limit(0)).count() == 0


def test_quotes_hidden_elements_and_formulas():
    texts = lambda page: [b.text for b in ht.blocks(page)]
    assert texts("<p data-x=it's>He said 'hello' and <b title = \"a>b\">went</b>.</p><p>Next</p>") == ["He said 'hello' and went.", "Next"]
    assert texts('<p>One</p><p title="abc>text</p><p>Two') == ["One", "text", "Two"]
    assert texts("<p a='b\"c>d' e=f\"g h>x</p><p i='>'>y</p>") == ["x", "y"]
    assert texts("<article><p>Let <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> be.</p>"
                 "</article>") == ["Let x=2 be."]
    assert texts("<div>a<svg><g><svg><text>in</text></svg><text>in</text></g></svg>b</div>c") == ["ab", "c"]
    assert texts("<article><div><canvas>old browser</div><p>Stays.</p></article><p>Too.</p>") == ["Stays.", "Too."]
    assert texts("<section><object><p>fallback</p><object>x</object></section><p>After.") == ["After."]
    assert texts("<div><video><p>none</video>seen</div>") == ["seen"]
    assert texts("a<![CDATA[b<c]]>d<![CDATA[e>f") == ["ab<cdf"]
    assert texts("<p>x</p><a href='y") == ["x"] and texts("1 < 2 <") == ["1 < 2 <"] and texts("a </ b") == ["a </ b"]


@pytest.mark.parametrize("unit", ["<a ", "<a b=\"", "<a =\"> \"", "<![CDATA[>", "<!-- ", "<p x='", "<object>", "</p", "<a href=x'>", "<script"])
def test_odd_pages_take_linear_time(unit):
    import time
    took = []
    for size in (20_000, 200_000):
        page, start = unit * (size // len(unit)), time.process_time()
        ht.blocks("<p>text</p>" + page)
        took.append(time.process_time() - start)
    assert took[1] < 2.0 and took[1] < 40 * max(took[0], 0.01)
