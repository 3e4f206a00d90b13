import random

from growret.llm.html_extract import KEPT, UNDECIDED, common_lines, extract, page_lines
from tests.llm.cases import collected

PAGES = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_marked_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="ad banner">Buy</div><aside>More</aside><div id="cookie-notice">We use</div><!-- <p>gone</p> -->
    <article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>,\n two&nbsp;&#233;<br>three<p><b>Open.<br><p>Last</b>.
    <ul><li>x<li>y</ul><div class="share-buttons">Share</div><form><p>Name</p></form><span hidden>no</span>
    <section class="comments"><p>Me too!</p></section></article><footer>&copy;</footer>"""
    assert page_lines(page) == [(t, KEPT) for t in ("Head&line", "One bold, two é three", "Open.", "Last.", "x", "y")]


def test_broken_markup():
    assert page_lines("") == [] and page_lines("<script>x") == [] and page_lines("<!-- <p>x") == []
    assert page_lines("a < b <p>c</p> <p title='>'>d") == [("a < b", UNDECIDED), ("c", UNDECIDED), ("d", UNDECIDED)]
    assert page_lines("<nav><p>x</nav>y</div></p>z") == [("yz", UNDECIDED)] or [t for t, _ in page_lines("<nav><p>x</nav>y</div></p>z")] == ["y", "z"]
    assert [t for t, _ in page_lines("<article><p>" + "word " * 20000)] == [("word " * 20000).strip()]


def test_neighbours_lines_are_deleted_from_unmarked_pages(spark):
    page = lambda k: f"<div>Welcome to us</div><p>Body of page {k}</p><p>Second {k}</p><p>Third {k}</p><div>Contact | Terms</div>"
    rows = [(k, f"https://h.org/news/{k}.html", page(k)) for k in range(9)] + [(50, "https://other.org/x", page(50))]
    got = texts(spark, rows)
    assert all(got[k] == f"Body of page {k}\nSecond {k}\nThird {k}" for k in range(9))
    assert got[50].startswith("Welcome to us\n")  # alone on its host


def test_a_copy_teaches_nothing_and_articles_keep_shared_paragraphs(spark):
    whole = "<p>Alpha</p><p>Beta</p><div>Foot</div>"
    other = "<p>Gamma</p><p>Delta</p><div>Foot</div>"
    rows = [(1, "http://h/a/1", whole), (2, "http://h/a/2", whole), (3, "http://h/a/3", other)]
    assert texts(spark, rows) == {1: "Alpha\nBeta", 2: "Alpha\nBeta", 3: "Gamma\nDelta"}
    quote = "<article><p>Licence line</p><p>Text {}</p><div>Read on</div></article>"
    rows = [(k, f"http://h/{k}", quote.format(k) + f"<p>{k}</p>") for k in range(4)]
    rows = [(i, u, h.replace("<div>", f"<p>More {i}</p><p>Even more {i}</p><div>")) for i, u, h in rows]
    assert texts(spark, rows)[2] == "Licence line\nText 2\nMore 2\nEven more 2"


def test_a_template_longer_than_the_article_is_deleted(spark):
    frame = "<div>Menu</div><div>Topics</div>{}<div>We use</div><div>Foot</div>"
    own = lambda k: "".join(f"<p>Line {i} of {k}</p>" for i in range(3))
    rows = [(k, f"http://h/{k}", frame.format(own(k))) for k in range(8)]
    rows += [(k, f"http://short/{k}", frame.format(f"<p>Only {k}</p>")) for k in range(8)]
    got = texts(spark, [(i + 100 * u.count("short"), u, h) for i, u, h in rows])
    assert all(got[k] == f"Line 0 of {k}\nLine 1 of {k}\nLine 2 of {k}" and got[100 + k] == f"Only {k}" for k in range(8))


def test_near_copies_keep_what_they_share(spark):
    body = "".join(f"<p>Shared {i}</p>" for i in range(12))
    rows = [(k, f"http://h/a/{k:03}", f"<div>Menu</div>{body}<p>Seen {k} times</p>") for k in range(40)]
    rows += [(100 + k, f"http://h/b/{k:03}", f"<div>Menu</div><p>Own {k}</p><p>Other {k}</p>") for k in range(60)]
    got = texts(spark, rows)
    assert all("Shared 5" in got[k] for k in range(40)) and all(got[100 + k] == f"Own {k}\nOther {k}" for k in range(60))


def test_copies_in_a_row_hide_no_partner(spark):
    copy = "<div>Menu</div><p>Alpha</p><p>Beta</p><div>Foot</div>"
    rows = [(k, f"http://h/a/list?page={k}", copy) for k in range(60)]
    rows += [(100 + k, f"http://h/b/{k}", f"<div>Menu</div><p>One {k}</p><p>Two {k}</p><div>Foot</div>") for k in range(2)]
    # each page of the second host holds all lines of /m, but for the last ones
    rows += [(200, "http://g/m", "<div>Menu</div><p>Gamma</p>")]
    rows += [(300 + k, f"http://g/n/{k:03}", f"<div>Menu</div><p>Gamma</p><p>More {k}</p>") for k in range(150)]
    rows += [(500, "http://g/z", "<div>Menu</div><p>Delta</p><p>Epsilon</p>")]
    got = texts(spark, rows)
    assert {got[k] for k in range(60)} == {"Alpha\nBeta"} and got[101] == "One 1\nTwo 1"
    assert got[200] == "Gamma"


def test_cells_are_dealt_without_a_seam(spark, monkeypatch):
    from growret.llm import html_extract

    r = random.Random(3)
    rows = []
    for k in range(120):
        own = "".join(f"<p>{r.random()}</p>" for _ in range(5))
        rows.append((k, f"https://big.org/{k // 10}/{k}", f"<div>Menu {k // 10}</div>{own}<div>End</div>"))
    one = texts(spark, rows)
    monkeypatch.setattr(html_extract, "CELL", 16)
    assert texts(spark, rows) == one
    assert not any("End" in t or "Menu" in t for t in one.values())


def test_messy_rows_and_empty_table(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (None, "http://h/x", "<p>a</p>"), (3, "http://h/x", "<p>a</p>"), (3, "http://h/x", "<p>a</p>")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as text", "1 as row", "2 as cell")
    got = collected(extract(df), "page_id", "url", "text", "n_chars")
    assert got == sorted([(1, None, "", 0), (2, "no scheme", "", 0), (3, "http://h/x", "a", 1), (3, "http://h/x", "a", 1), (None, "http://h/x", "a", 1)], key=lambda r: (r[0] is None, r[0]))
    assert extract(spark.createDataFrame([], PAGES)).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(200):
        a, b = ([r.randrange(5) for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = common_lines(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and got == sorted(set(got)) and all(a[k] in it for k in got)


def test_listed_words_around_or_on_the_only_article_lose_nothing():
    body = "<p>One.</p><p>Two.</p>"
    for page in (
        f'<div class="layout has-sidebar"><article>{body}</article></div>',
        f'<article class="post comments-open">{body}</article>',
        f'<div id="page" class="no-sidebar">{body}</div>',
        f'<article class="post category-related">{body}</article>',
        f'<div class="no-sidebar"><article>{body}<div class="share">Share</div></article>'
        '<section class="comments"><article class="comment"><p>Me too!</p></article></section></div>',
    ):
        assert [t for t, _ in page_lines(page)] == ["One.", "Two."]
    assert [t for t, _ in page_lines('<p>Text</p><div class="newsletter"><p>Sign up</p></div>')] == ["Text"]


def test_broken_pages_take_linear_time():
    import time

    for piece in ("<a ", "<!", "</", "<a '", "<b>", "<div></x>", "<b><div></div>t"):
        page = "<p>x</p>" + piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        lines = page_lines(page)
        assert time.perf_counter() - began < 20 and lines[0] == ("x", UNDECIDED)  # a quadratic scan takes many minutes
    assert page_lines("<p>x</p> 1 <a 2") == [("x", UNDECIDED), ("1 <a 2", UNDECIDED)]
