"""Main text of literal pages."""

from leadloom.llm.html_extract import extract, main_text

P1 = "The harbour was quiet, and the boats lay still, as they had for a week."
P2 = "Nobody in the town could say, when asked, why the ferry had stopped."
PAGE = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{margin:0}}</style><script>var t="</p>";track(1);</script></head><body>
<header class="site"><a href="/">Home</a><p>A site about boats, harbours, and the sea, for all who like them.</p></header>
<nav><ul><li><a href="/a">One, two, three, four</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy a boat, a big one, now, today, at once, cheap.</div>
<div id="cookie-notice"><p>We use cookies, and so do others, to show adverts, as you like.</p></div>
<article><header><h1>The &amp; harbour</h1></header><p><b>{P1}</b><br><p>{P2}
<ul><li>first thing<li>second thing</ul><script>x()</script><blockquote>Quoted &#233; text</blockquote>
<form><p>Sign up, please, for news, and more news, and yet more news.</p></form></article>
<aside><p>Other stories, which are long, and have commas, and more commas, here.</p></aside>
<section id="comments"><div class="comment-body"><p>I think, as a reader, that this is wrong, very wrong indeed.</p></div></section>
<footer>&copy; 2024 someone, somewhere</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE) == f"The & harbour {P1} {P2} first thing second thing Quoted \u00e9 text"


def test_containers_without_article():
    long = " ".join([P1] * 4)
    html = f"<body><div class=menu><a href=x>menu</a></div><div><h1>Head</h1><div class=post-content><p>{long}<p>{long}</div></div><div><p><a href=y>{P1}</a></div>"
    assert main_text(html) == f"Head {long} {long}"
    assert main_text(f"<body><div>{P1}<br><br>{P2}</div>") == f"{P1} {P2}"


def test_odd_pages(spark):
    rows = [(1, "u", None, 0), (2, "u", "", 0), (3, "u", "plain", 0), (4, "u", "<p>cut <b", 0), (5, "u", "<div>" * 3000 + P1, 0), (5, "u", "<div>" * 3000 + P1, 0), (None, None, "</p></div>a\n b&nbsp;c", 0)]
    found = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    texts = [r.text for r in found]
    assert texts == ["", "", "plain", "cut", P1, P1, "a b c"] and [r.n_chars for r in found] == [len(t) for t in texts]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_comments_go_whatever_the_element():
    body = "The bridge was opened in spring, after ten years of work, and the town came to see it."
    page = f'<body><article><p>{body}</p><p>{body}</p><article class="comment"><p>{body} No, said a reader, it was not.</p></article></article><article id="comments"><p>{body} Nor I.</p></article></body>'
    assert main_text(page) == f"{body} {body}"


def test_names_do_not_empty_a_page():
    body = "The bridge was opened in spring, after ten years of work, and the town came to see it."
    for names in ("content legal", "discussion", "related"):
        assert main_text(f'<body><div class="{names}"><p>{body}</p><p>{body}</p></div><nav>Home</nav></body>') == f"{body} {body}"


def test_short_sentences_beside_the_article_stay():
    body = "The bridge was opened in spring, after ten years of work, and the town came to see it."
    page = f"<body><div><p>{body}</p><p>{body}</p></div><p>It still stands.</p><p><a href=x>More news.</a></p></body>"
    assert main_text(page) == f"{body} {body} It still stands."


def test_generated_pages():
    import random

    rng = random.Random(5)
    for _ in range(60):
        sentences = [", ".join(f"word{rng.randint(0, 999)} and more of it" for _ in range(rng.randint(3, 8))) + "." for _ in range(rng.randint(2, 60))]
        junk = [
            "<nav><ul>" + "".join(f"<li><a href=#>Item {k}</a></li>" for k in range(9)) + "</ul></nav>",
            "<div class='sidebar'><p>Follow us, like us, share us, and never miss a story of ours again.</p></div>",
            "<script>var x = '<p>no</p>';</script><style>p {}</style>",
            "<footer><p>All rights reserved, by the owners, in all countries of the world, for ever.</p></footer>",
            "<div id='comments'><p>First, I say, first of all readers, to be here today, and glad.</p></div>",
            "<div class='ad-banner'><p>Buy now, pay later, at prices, which you will not believe, ever.</p></div>",
        ]
        rng.shuffle(junk)
        at = rng.randint(0, len(junk))
        depth = rng.choice([1, 2, 40])
        inner = "".join(f"<p>{s}</p>\n" for s in sentences)
        article = "<div>" * depth + rng.choice(["<article>{}</article>", "<div class='post-content'>{}</div>", "<section>{}</section>"]).format(inner) + "</div>" * depth
        assert main_text("<html><body>" + "".join(junk[:at]) + article + "".join(junk[at:]) + "</body></html>") == " ".join(sentences)


def test_very_long_and_tied_pages(spark):
    from leadloom.llm.html_extract import extract

    long = "<body>" + "<div><p>One long line of text, with commas, and more.</p>" * 20_000
    tied = "<body><div><p>Left text, of the same length, and score.</p></div><div><p>Next text, of the same length, and score.</p></div></body>"
    found = {r.page_id: r for r in extract(spark.createDataFrame([(1, "u", long), (2, "u", tied), (2, "u", tied), (3, None, None)], "page_id long, url string, html string")).collect()}
    assert found[1].n_chars > 0 and found[3].text == "" and "Left text" in found[2].text
