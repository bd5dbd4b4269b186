"""HTML extraction: planted articles among boilerplate, broken markup, edge rows."""

import random
import re
from html import escape, unescape

import duckdb

from paneloom.llm.html_text import content_lines, extract_text, main_text, smoothed

WORDS = "the cat sat on a mat & ate <fish> with 3 \"friends\" über café".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def page(rng, article_tag="article"):
    blocks = [sentence(rng, rng.choice([1, 2, 30, 80])) for _ in range(rng.randint(1, 12))]
    menu = "".join(f'<li><a href="/{i}">{sentence(rng, 2)}</a></li>'.replace("& ", "&amp; ") for i in range(6))
    body = "".join(f"<p>{escape(b)}</p>\n" for b in blocks[1:])
    open_tag = f"<{article_tag}>" if article_tag != "div" else '<div class="content">'
    html = (
        f"<!DOCTYPE html><html><head><title>{escape(blocks[0])}</title><style>p{{x:1}}</style><script>var a='</p>';"
        f"</script></head><body><header><h2>Site name</h2></header><nav><ul>{menu}</ul></nav>"
        f'<div class="cookie-notice">{escape(sentence(rng, 40))}</div><div class="ad">{escape(sentence(rng, 50))}</div>'
        f"{open_tag}<h1>{escape(blocks[0])}</h1>{body}</{article_tag}><aside>{escape(sentence(rng, 60))}</aside>"
        f'<form><label>Mail</label><input name="m"><p>{escape(sentence(rng, 30))}</p></form>'
        f'<section id="comments"><p>{escape(sentence(rng, 90))}</p></section>'
        f"<footer>&copy; {escape(sentence(rng, 20))}</footer></body></html>"
    )
    return html, "\n".join(blocks)


def test_planted_articles():
    rng = random.Random(2)
    for tag in ["article", "main"] * 150:
        html, want = page(rng, tag)
        assert main_text(html) == want


def test_plain_divs_keep_long_text():
    rng = random.Random(8)
    for _ in range(50):
        blocks = [sentence(rng, 60) for _ in range(6)]
        html = "<body><div><a>Home</a> <a>News</a> <a>About</a></div><div>" + "".join(
            f"<p>{escape(b)}</p>" for b in blocks) + "</div><div><a>Terms</a><a>Help</a></div></body>"
        assert main_text(html) == "\n".join(blocks)


def test_articles_split_over_siblings_stay_whole():
    rng = random.Random(9)
    menu = "<div><a>Home</a> <a>News</a> <a>About</a></div>"
    for tag in ["div", "section", "td"] * 10:
        parts = [[sentence(rng, 60) for _ in range(n)] for n in (2, 1, 3, 1)]
        inside = "".join(f"<{tag}>" + "".join(f"<p>{escape(b)}</p>" for b in part) + f"</{tag}>" for part in parts)
        inside = f"<table><tr>{inside}</tr></table>" if tag == "td" else inside
        assert main_text(f"<body>{menu}{inside}{menu}</body>") == "\n".join(sum(parts, []))
    long = [sentence(rng, 60) for _ in range(4)]
    html = "".join(f"<article><h2>Post {i}</h2><p>{escape(b)}</p></article>" for i, b in enumerate(long))
    assert main_text(f"<body>{menu}{html}{menu}</body>") == "\n".join(f"Post {i}\n{b}" for i, b in enumerate(long))


def test_hints_do_not_take_the_article():
    rng = random.Random(10)
    blocks = [sentence(rng, 60) for _ in range(5)]
    inside = "".join(f"<p>{escape(b)}</p>" for b in blocks)
    small = f"<div class='cookie-notice'>{escape(sentence(rng, 20))}</div>"
    for name in ["content no-sidebar", "layout with-header", "entry related-2024", "post widget", "legal", "withHeader"]:
        for html in (f"<div class='{name}'>{inside}</div>", f"<article><div id='{name}'>{inside}</div></article>",
                     f"<section class='{name}'><article>{inside}</article></section>"):
            assert main_text(f"<body>{small}{html}{small}</body>") == "\n".join(blocks)
    half = f"<div class='entry related-2024'>{inside}</div><div class='content no-sidebar'>{inside}</div>"
    assert main_text(f"<body>{small}{half}</body>") == "\n".join(blocks * 2)


def test_details():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("no tags &amp; all") == "no tags & all"
    assert main_text("<article><p><b>One two<br>three<p>Four\n\t five</article>") == "One two three\nFour five"
    assert main_text("<article>a<script>if (x < 3) '</p>'</script>b</article>") == "ab"
    assert main_text("<article><p>x<div class='comments'><p>no</div><p>y&eacute;&#65;</article>") == "x\nyéA"
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert len(main_text("<article><p>" + "word " * 200_000 + "</article>")) == 5 * 200_000 - 1


def test_smoothing_and_clustering():
    assert smoothed([5.0] * 7) == [5.0] * 7
    flat = smoothed([0, 0, 10, 0, 0])
    assert max(flat) == flat[2] and abs(flat[1] - flat[3]) < 1e-12
    lines = [("m", 6, 0)] * 6 + [("t" * 300, 2, 0)] * 4 + [("m", 6, 0)] * 6
    assert set(range(6, 10)) <= set(content_lines(lines)) < set(range(16))


def test_given_pages(spark):
    source = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{source}/pages.parquet")
    found = {r.page_id: r.text for r in extract_text(pages).collect()}
    given = duckdb.connect().execute(f"select page_id, html from '{source}/pages.parquet'").fetchall()
    assert len(found) == len(given)
    for i, html in given:
        inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert found[i] == "\n".join(b for b in blocks if b)


def test_edge_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>t</p>", "y"), (None, "u", "<p>t</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in extract_text(pages).collect()) == [("", 0), ("", 0), ("t", 1), ("t", 1)]
    assert extract_text(pages.limit(0)).count() == 0


def test_containers_decide_and_not_their_names():
    """The given pages give the same text when article and main become div."""
    import pyarrow.parquet as pq

    for html in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", html)) == main_text(html)


def test_short_paragraphs_around_long_ones_stay():
    long, short = "A long paragraph with many words in it, and some more of them. " * 5, "A short one."
    lines = ["Heading", short, short, short, long.strip(), long.strip(), long.strip(), "Closing.", short]
    body = "<h1>Heading</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])
    menu = "<nav><a href=a>Menu</a></nav>"
    for page in (f"<body>{menu}<div>{body}</div></body>", f"<body>{menu}<section><div>{body}</div></section></body>",
                 f"<body>{menu}<article>{body}</article></body>"):
        assert main_text(page) == "\n".join(lines)
    parts = "".join(f"<div><p>{x}</p></div>" for x in lines[4:7])
    assert main_text(f"<body>{menu}<div><h1>Heading</h1>{parts}<div><p>Closing.</p></div></div></body>") == "\n".join(
        ["Heading", *lines[4:7], "Closing."]
    )
