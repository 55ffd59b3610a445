import pytest

from tallyward.llm.html_text import extract_text, main_text

P1 = "A first paragraph that says enough to be taken for content, with words & more."
P2 = "A second paragraph goes on for a while, with a <a href='x'>link</a> in it, and ends."
P2_TEXT = "A second paragraph goes on for a while, with a link in it, and ends."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body><script>var x = '<p>no</p>';</script><style>p{}</style></body></html>", ""),
        ("just text &amp; no tags", "just text & no tags"),
        (f"<body><nav><a href=1>Home</a></nav><article><h1>T</h1><p>{P1.replace('&', '&amp;')}</p><p>{P2}</p></article><footer>Owner and a long line of other text about it</footer></body>", f"T\n{P1}\n{P2_TEXT}"),
        # No article, furniture named by class or id; a short article is thinner than its surroundings.
        (f"<body><div id='header'><a href=1>Home</a> Site</div><div class='cookie-notice'>We use cookies to do many things, please accept them all</div><div class='content'><h1>Title</h1><p>{P2}</p><p>Short.</p></div><div class='right-sidebar'><p>{P1}</p></div><div id=comments><p>Great read, thank you so much for all of this!</p></div></body>", f"Title\n{P2_TEXT}\nShort."),
        # Furniture that does not say so is mostly links.
        (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Contact</a></div><div><h2>Story</h2><div><p>{P2}</p><p>{P2}</p></div></div><div><a href=4>Terms</a> <a href=5>Privacy</a></div></body>", f"Story\n{P2_TEXT}\n{P2_TEXT}"),
        # Missing end tags, line breaks, white space, references, a page cut off.
        ("<article><h1>T  one</h1><p><b>Bold\n and<br> more<br><p>Next &eacute;&#33;<ul><li>a<li>b</ul><table><tr><td>c<td>d", "T one\nBold and more\nNext é!\na\nb\nc\nd"),
        ("<article><p>Some text here that is long enough.</p><form>Name <input><button>Go</button></form><aside>Aside text</aside><p hidden>no</p><p style='display: none'>no</p><!-- no --><p>End of it all, really.</p></article>", "Some text here that is long enough.\nEnd of it all, really."),
        ("<main><header><h1>Head</h1><p>by somebody</p></header><p>Body of the text is here.</p><footer>foot</footer></main></div></p></b>", "Head\nBody of the text is here."),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


def test_all_of_an_article_beside_its_core():
    """Long lists, tables and nested sections have the core; what is shorter or thinner stays, links do not."""
    def paragraphs(n, size):
        return [f"{c}{'x' * (size - 2)}." for c in "abcdefgh"[:n]]

    def marked_up(parts, tag):
        return "".join(f"<{tag}>{p}</{tag}>" for p in parts)

    links = "<div><a href=1>One more story</a> <a href=2>Another story</a></div>"
    few, many, long = paragraphs(3, 100), ["y" * 100] * 20, paragraphs(5, 400)
    for page in ("<article>{}</article>", "<main><div>{}</div></main>", "<body><div>{}</div></body>"):
        listed = marked_up(few, "p") + links + f"<ul>{marked_up(many, 'li')}</ul>"
        assert main_text(page.format(listed)) == "\n".join(few + many)
        table = marked_up(few, "p") + f"<table>{'<tr><td>' + 'z' * 90 + '</td></tr>'}{marked_up(['<td>' + m + '</td>' for m in many], 'tr')}</table>"
        assert main_text(page.format(table)) == "\n".join(few + ["z" * 90] + many)
        short = paragraphs(5, 200)
        sections = f"<section><h2>A</h2>{marked_up(long, 'p')}</section><section><h2>B</h2>{marked_up(short, 'p')}</section>{links}"
        assert main_text(page.format(sections)) == "\n".join(["A", *long, "B", *short])
    assert main_text(f"<article>See <a href=1>this link</a> first.<div>{marked_up(long, 'p')}</div></article>").startswith("See this link first.")


@pytest.mark.parametrize(
    "html, text",
    [
        # The whole page stands in one form; another one asks for a name.
        (f"<body><form><div><h2>T</h2><p>{P2}</p><p>{P2}</p></div></form></body>", f"T\n{P2_TEXT}\n{P2_TEXT}"),
        (f"<body><form><nav><a href=1>Home</a></nav><article><p>{P2}</p></article></form></body>", P2_TEXT),
        (f"<body><div><p>{P2}</p><p>{P2}</p></div><form>Name <input></form></body>", f"{P2_TEXT}\n{P2_TEXT}"),
        # Names that content has as well.
        *(
            (f"<article><h1>T</h1><p>{P2}</p><div {name}><p>{P2}</p></div></article>", f"T\n{P2_TEXT}\n{P2_TEXT}")
            for name in ("class='elementor-widget-text-editor'", "id='related-work'", "class=search-history", "class=social-policy")
        ),
        (f"<article><h2>T</h2><div class=widget><p>{P2}</p><p>{P2}</p></div></article>", f"T\n{P2_TEXT}\n{P2_TEXT}"),
        # A node called comment has most of its article, or is one below it.
        (f"<article><h1>T</h1><div class=comment><p>{P2}</p></div></article>", f"T\n{P2_TEXT}"),
        (f"<article><h1>T</h1><p>{P2}</p><p>{P2}</p><div class=comment><p>{P2}</p></div></article>", f"T\n{P2_TEXT}\n{P2_TEXT}"),
        # Names that only begin like furniture, and words of code that are called so.
        (f"<article><h1>T</h1><p>{P2}</p><section class='ad-hoc-queries'><p>{P2}</p></section><div class='menu-of-the-day'>Soup</div></article>", f"T\n{P2_TEXT}\n{P2_TEXT}\nSoup"),
        (f"<article><p>{P2}</p><pre>x = 1 <span class='token comment'># one</span> <span class=hljs-comment>// two</span></pre></article>", f"{P2_TEXT}\nx = 1 # one // two"),
        (f"<article><p>{P2}</p><p>{P2}</p><section class='comments-area'><p>Great!</p></section><div class='ad-slot-2'>Buy</div><div id='nav_links1'>Next</div></article>", f"{P2_TEXT}\n{P2_TEXT}"),
        # Margins of a page that say nothing of themselves.
        (f"<body><div>We use cookies.</div><div><h2>Story</h2>{f'<p>{P2}</p>' * 4}</div><div>Copyright 2024 Somebody</div></body>", "\n".join(["Story", *[P2_TEXT] * 4])),
        (f"<body><div><h1>Title</h1></div><div>{f'<p>{P2}</p>' * 4}</div><div><p>{P2}</p></div></body>", "\n".join(["Title", *[P2_TEXT] * 5])),
        # Furniture with links, with two such names, and hidden.
        (f"<article><p>{P2}</p><div class=related><a href=1>One</a> <a href=2>Two</a></div><div class='social-share'>Tell all</div></article>", P2_TEXT),
        (f"<article><p>Short.</p><div hidden><p>{P2}</p></div></article>", "Short."),
    ],
)
def test_content_in_what_furniture_is_called(html, text):
    assert main_text(html) == text


def test_deep_and_long():
    deep = "<div>" * 3000 + "<p>deep</p><p>down</p>" + "</div>" * 3000
    assert main_text(f"<body>{deep}</body>") == "deep\ndown"
    assert len(main_text("<article>" + "<p>some words in it</p>" * 20_000 + "</article>")) == 20_000 * 17 - 1


def test_rows(spark):
    rows = [(1, "u", "<p>é text</p>", "x", 5), (None, None, None, "x", 5), (1, "u", "<p>é text</p>", "x", 5)]
    table = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING, n_chars INT")
    got = extract_text(table)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "é text", 6), (1, "u", "é text", 6), (None, None, "", 0)]
    assert extract_text(table.limit(0)).count() == 0


def test_given_pages(spark):
    """The article of every given page, by cutting it out with patterns that fit their template only."""
    import html as references
    import re

    for page in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page.html, re.S).group(1).replace("<br>", " ")
        blocks = [" ".join(references.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert main_text(page.html) == "\n".join(b for b in blocks if b)
