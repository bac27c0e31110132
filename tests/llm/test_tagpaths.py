import time

from ocelli.llm import tagpaths as T


def test_article_with_everything_around_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:'</p>'}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu, one. Two!</a></ul></nav><div class="cookie-notice"><p>We use cookies, as all do.</p></div>
    <article><h1>A title</h1><script>var t="</p>";</script><p><b>First &amp; foremost,
      text&nbsp;here.<br>More<p>Second.</p><!-- <p>hidden</p> --><ul><li>One<li>Two</ul><aside>An aside.</aside><div class="comments"><p>Nice one, really, thanks.</p></div></article>
    <form><p>Sign up, please.</p></form><div id="sidebar"><p>Other, longer news than this article has, and more, and more.</p></div><footer>&copy; me, you.</footer></body></html>"""
    assert T.main_text(page) == "A title\nFirst & foremost, text here. More\nSecond.\nOne\nTwo"


def test_without_marked_elements():
    page = "<body><div><a href=x>Home</a> <a href=y>News</a></div><div><h2>Head</h2><p>A first paragraph, with commas, and stops. Long enough.</p><p>Tiny.</p><p>Another paragraph, also with commas, and a stop.</p></div><div><a>About us</a></div></body>"
    assert T.main_text(page) == "Head\nA first paragraph, with commas, and stops. Long enough.\nTiny.\nAnother paragraph, also with commas, and a stop."


def test_marked_by_class_only():
    page = '<div class="nav-bar">x</div><div class="post-content"><p>Body text, of some length. It goes on, and on.</p></div><div class="related"><p>Other text, of some length. It goes on.</p></div>'
    assert T.main_text(page) == "Body text, of some length. It goes on, and on."


def test_names_of_layouts():
    assert T.main_text('<div class="layout no-sidebar"><article><p>Text, here.</p></article></div>') == "Text, here."
    assert T.main_text('<div id="comments-page"><p>All there is, here.</p></div>') == "All there is, here."


def test_odd_pages():
    assert T.main_text(None) == T.main_text("") == T.main_text("<p></p>") == T.main_text("<script>x") == ""
    assert T.main_text("just text, no tags") == "just text, no tags"
    assert T.main_text("<p>a < b & c &lt; d</p>") == "a < b & c < d"
    assert T.main_text("<article><p>open <b>bold") == "open bold"
    assert T.main_text("<article>" + "<div>" * 2000 + "deep, text." + "</div>" * 2000) == "deep, text."
    assert T.main_text('<article><p title="a>b">x, y.</p></article>') == "x, y."
    assert T.main_text("<" * 5000) == "<" * 5000


def test_column(spark):
    rows = [(1, "u", "<article><p>One, two.</p></article>"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>One, two.</p></article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, T.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "One, two.", 9), (2, None, "", 0), (None, "u", "", 0), (1, "u", "One, two.", 9)], key=repr)
    assert T.extract(df.limit(0)).collect() == []


def test_driver_pages_keep_every_paragraph(spark):
    import html
    import re

    for r in T.extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert r.text.split("\n") == [x for x in want if x]


PARAGRAPH = "Some text of the article, with commas, and stops. It goes on, and on, for a while."


def test_scores_choose_on_marked_pages_too():
    text = f"<p>{PARAGRAPH}</p>" * 2
    assert T.main_text(f"<article><h1>Title</h1>{text}<div><a href=x>Share this</a> <a href=y>Tweet it</a></div></article>") == "\n".join(["Title", PARAGRAPH, PARAGRAPH])
    assert T.main_text(f"<div><div><article><p>Read on</p></article></div><section>{text}</section></div>").endswith("\n".join([PARAGRAPH, PARAGRAPH]))


def test_all_of_the_article_stays():
    text = f"<p>{PARAGRAPH}</p>" * 3
    want = "\n".join([PARAGRAPH] * 3)
    assert T.main_text(f"<main><h1>Title</h1><p>Lead, here.</p><article>{text}</article></main>") == "Title\nLead, here.\n" + want
    assert T.main_text(f"<div class=post><h1>Title</h1><div class=body>{text}</div></div>") == "Title\n" + want
    assert T.main_text("<article><p>First part, of it.</p></article><article><p>Second part, of it.</p></article>") == "First part, of it.\nSecond part, of it."
    assert T.main_text(f"<div><h1>Title</h1><article>{text}</article><article>{text}</article></div>") == "Title\n" + want + "\n" + want


def test_a_form_around_the_page():
    text = f"<p>{PARAGRAPH}</p>"
    assert T.main_text(f"<form><div>{text}</div></form>") == T.main_text(f"<form><article>{text}</article></form>") == PARAGRAPH
    assert T.main_text(f"<div>{text}{text}</div><form><p>Sign up, please.</p></form>") == PARAGRAPH + "\n" + PARAGRAPH


def test_markup_never_follows_a_script():
    assert T.main_text('<article><p>One.</p><script>var s="<!--";</script><p>Two.</p></article><footer>F</footer>') == "One.\nTwo."
    assert T.main_text("<article><script>for(i=0;i<n;i++){} // don't</script><p>Alpha.</p><p>It's fine, here.</p></article>") == "Alpha.\nIt's fine, here."
    assert T.main_text('<article><p>A, b.</p><style>a{content:"<p>"}</style><textarea><p>no</textarea><p>C, d.</p></article>') == "A, b.\nC, d."


TWICE = f"<h1>Title</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
PLAIN = f"Title\n{PARAGRAPH}\n{PARAGRAPH}"


def test_a_name_alone_drops_nothing_of_the_article():
    for inner in ('<section class="discussion"><p>{}</p></section>', '<div class="related-work"><p>{}</p></div>', '<p class="alert">{}</p>'):
        assert T.main_text(f"<article>{TWICE}{inner.format('Own. ' + PARAGRAPH)}</article>") == f"{PLAIN}\nOwn. {PARAGRAPH}"
    assert T.main_text(f'<article>{TWICE}<div class="ad">Buy it now.</div><p class="share">Share it, here</p></article>') == PLAIN


def test_comment_lists_by_their_shape():
    unit = '<div class="x{}"><span class="u">{}</span> <time>today</time><p>Nice one, I think. Really, good work here, as I said before.</p></div>'
    units = f'<div class="q">{unit.format(1, "Ann")}{unit.format(1, "Bob")}</div>'
    for page in (f"<article>{TWICE}{units}</article>", f"<article>{TWICE}</article>{units}", f"<div>{TWICE}</div>{units}"):
        assert T.main_text(page) == PLAIN
    # Alike parts with headings, or without an author or a time, are an article's own.
    parts = "".join(f'<section class="s"><h2>Part {k}</h2><time>now</time><p>{PARAGRAPH}</p></section>' for k in range(2))
    assert T.main_text(f"<article>{parts}</article>").count(PARAGRAPH) == 2
    assert T.main_text(f'<article>{TWICE}<div class="s"><p>One, two.</p></div><div class="s"><p>Three, four.</p></div></article>') == PLAIN + "\nOne, two.\nThree, four."


def brute_paths(page):
    """Text blocks, and those whose path's smoothed ratio is over the threshold: another parser and plain loops, no names and no marks."""
    import html.parser
    import math
    import re

    class P(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.up, self.out, self.fresh, self.link = [], [], True, 0

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.link += 1
            elif tag == "br":
                self.handle_data(" ")
            elif tag not in ("b", "meta"):
                if self.up and self.up[-1] in ("p", "h1"):
                    self.up.pop()
                self.up.append(tag)
                self.fresh = True

        def handle_endtag(self, tag):
            if tag == "a":
                self.link -= 1
            elif tag not in ("b", "br"):
                if tag in self.up:
                    while self.up.pop() != tag:
                        pass
                self.fresh = True

        def handle_data(self, text):
            if {"head", "nav", "footer", "script", "style", "title"} & set(self.up) or self.fresh and not text.strip():
                return
            if self.fresh:
                self.out.append([tuple(self.up), "", 0])
                self.fresh = False
            self.out[-1][1] += text
            self.out[-1][2] += len(text) * (self.link > 0)

    p = P()
    p.feed(page)
    blocks = [(path, " ".join(text.split()), links) for path, text, links in p.out if text.strip()]
    stat = {}
    for path in {b[0] for b in blocks}:
        own = [b for b in blocks if b[0] == path]
        stat[path] = (
            math.log1p(sum(max(0, len(t) - 1.5 * k) for _, t, k in own) / len(own)),
            math.log1p(sum(len(re.findall(r"[,.;:!?…。，、！？；：]", t)) for _, t, k in own if len(t) > 1.5 * k) / len(own)),
        )
    seen = [stat[b[0]] for b in blocks]
    sums = {}
    for i, b in enumerate(blocks):
        a, c = seen[max(i - 1, 0)], seen[min(i + 1, len(seen) - 1)]
        text, marks = (0.25 * a[k] + 0.5 * seen[i][k] + 0.25 * c[k] for k in (0, 1))
        sums.setdefault(b[0], []).append(text * (1 + marks))
    score = {path: sum(v) / len(v) for path, v in sums.items()}
    return blocks, score


def test_ratios_match_brute_force_and_choose_with_and_without_marks():
    import re

    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        plain = re.sub(r"<(/?)article>", r"<\1div>", r["html"])
        assert T.main_text(plain) == T.main_text(r["html"])  # the mark isn't what decides
        blocks, score = brute_paths(re.sub(r' class="ad"', "", plain))
        own, _ = T.cut(re.sub(r' class="ad"', "", plain))
        assert [(b.path, b.text) for b in own] == [b[:2] for b in blocks]
        ours = T.path_scores(own)
        assert {p: round(v, 9) for (p, _), v in ours.items()} == {p: round(v, 9) for p, v in score.items()}
        best = max(score.values())
        chosen = [t for p, t, _ in blocks if score[p] >= T.THRESHOLD * best and p[-1] == "p"]
        assert not [t for t in chosen if t not in T.main_text(plain).split("\n")]


def test_odd_rows_with_clashing_names(odd, none):
    out = T.extract(odd, "doc_id", "source", "text")
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == odd.count()
    assert {r.n_chars for r in out.filter("text = ''").collect()} == {0}
    assert T.extract(none, "doc_id", "source", "text").collect() == []


def test_malformed_pages_take_time_in_proportion():
    n = 1 << 20
    pages = {
        "unterminated": "<a " * (n // 3),
        "terminated once": "<p>text " + "<a " * (n // 3) + ">",
        "open quotes": '<a "x>x"' * (n // 8),
        "one kind of quote": "<a '>" * (n // 5),
        "unclosed": "<div>some text, here " * (n // 21),
        "nested": "<div>" * 300 + "<p>word, word." * (n // 14),
        "unmatched": "</section>x" * (n // 11),
        "deep and unmatched": "<div>" * (n // 16) + "</section>x" * (n // 16),
        "script ends": "<script></script " * (n // 17),
        "comments": "<!-- " * (n // 5),
        "declarations": "<! " * (n // 3),
        "articles": "<article><p>Some words, and more of them here.</p></article>" * (n // 60),
    }
    for name, page in pages.items():
        began = time.process_time()
        T.main_text(page)
        assert time.process_time() - began < 8, name


def test_ends_of_pages_stay():
    assert T.main_text("<p>One, two.</p><p>a <b>c</b> < d <!-- open <p>x</p>") == "One, two.\na c < d"
    assert T.main_text("<p>One, two, three.</p> and <a href=") == "One, two, three.\nand <a href="
    assert T.main_text("<p>One, two, three.</p> and <!-- no end") == "One, two, three.\nand"
    assert T.main_text("<p>One, two.</p><script>var a = '<p>';") == "One, two."
