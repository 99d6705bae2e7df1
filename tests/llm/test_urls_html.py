import math
import random
import re
from collections import Counter, defaultdict

import pytest

from foreunc.llm import html, queries, urls

FOLDER = "/root/testdata/sf0.001"


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(rows, rules):
    """Host, path, rule, verdict and template of (page_id, url) rows by loops."""
    found = []
    for page, url in rows:
        host, path = split_url(url)
        fits = [
            r for r in rules
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
        ]
        rule = max(fits, key=lambda r: (len(r.text), r.text), default=None)
        parts = [p for p in path.split("/") if p]
        if len(parts) > urls.DEPTH:
            parts = parts[: urls.DEPTH - 1] + ["/".join(parts[urls.DEPTH - 1 :])]
        found.append([page, host, path, rule and rule.text, rule and rule.verdict, parts, ""])
    for level in range(urls.DEPTH):
        here = [r for r in found if len(r[5]) > level]
        branches, nodes = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
        for r in here:
            for sums in (branches[r[1], r[6], r[5][level]], nodes[r[1], r[6]]):
                sums[0] += 1
                sums[1] += r[4] is not None
                sums[2] += r[4] == "block"
        def differs(part, size, all_part, all_size):
            if not size or size == all_size:
                return False
            pooled, rest = (all_part + 0.5) / (all_size + 1), all_size - size
            error = math.sqrt(pooled * (1 - pooled) * (1 / size + 1 / rest))
            return abs(part / size - (all_part - part) / rest) >= urls.DIFFERENCE * error

        alike = defaultdict(list)
        for (host, prefix, segment), (n, m, b) in branches.items():
            all_n, all_m, all_b = nodes[host, prefix]
            if n >= urls.MIN_URLS and (differs(m, n, all_m, all_n) or differs(b, m, all_b, all_m)):
                shares = (math.floor(urls.LIKE * x + 0.5) for x in (m / n, b / max(m, 1)))
                alike[host, prefix, *shares].append(segment)
        steps = {}
        for (host, prefix, *_), segments in alike.items():
            name = f"/={min(segments, key=str.encode)}" + (f"+{len(segments) - 1}" if len(segments) > 1 else "")
            steps.update({(host, prefix, s): name for s in segments})
        for r in here:
            r[6] += steps.get((r[1], r[6], r[5][level]), "/*")
    by_template, by_host = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0, 0])
    for r in found:
        for sums in (by_template[r[1], r[6]], by_host[r[1]]):
            sums[0] += r[4] is not None
            sums[1] += r[4] == "block"
            sums[2] += 1
    m, b, _ = map(sum, zip(*by_host.values(), strict=True))
    overall, k = (b + 0.5) / (m + 1), urls.SMOOTHING
    out = []
    for page, host, path, rule, label, _, prefix in found:
        of_host = (by_host[host][1] + k * overall) / (by_host[host][0] + k)
        labelled, blocked, n = by_template[host, prefix]
        bad = (blocked + k * of_host) / (labelled + k) >= urls.REJECT and labelled and labelled >= urls.COVERED * n
        out.append((page, host, path, rule, label or ("block" if bad else "allow"), prefix))
    return sorted(out, key=repr)


def test_filter_against_loops(spark):
    draw = random.Random(2)
    rules = [*queries.URL_RULES, urls.Rule("spam.net/x/", "block"), urls.Rule("spam.net/y/", "allow")]
    rows = []
    for i in range(2500):
        host = draw.choice(["Example.org", "a.example.org", "b.example.com", "spam.net", "www.spam.net", "com", "xcom"])
        path = draw.choice(["", "/", "//"]) + "/".join(
            [draw.choice(["en", "de", "fr", "es", "x", "y", "x"]), *(str(draw.randint(0, 3) * draw.randint(0, 40)) for _ in range(draw.randint(0, 11)))]
        )
        url = f"http://{host}{path}{draw.choice(['', '?q=/x#y', '#a/b', '/', '.html'])}"
        rows.append((i, url))
    rows += [(5000, None), (5001, ""), (5002, "no scheme"), (5003, "://"), (5004, "x://A.COM?://b/de/"), (None, "http://com/de/1")]
    rows += [rows[0], (5005, "http://a.com/de/" + "long/" * 5000), (5006, "http://É.ORG/é/ü?")]
    pages = spark.createDataFrame([(*r, "h", True) for r in rows], "page_id bigint, url string, host string, label boolean")
    got = urls.filter_urls(pages, rules).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, rules)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}
    assert urls.filter_urls(pages.filter("false"), rules).collect() == []


def verdicts(spark, paths, rules):
    rows = [(i, f"http://a.com/{p}") for i, p in enumerate(paths)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()
    return {paths[r.page_id]: r.verdict for r in got}


def test_branches_without_labels_are_left_alone(spark):
    block = [urls.Rule("a.com/de/", "block")]
    # One-sided hosts: a frequent branch without labels isn't judged by its labelled siblings,
    paths = [f"de/{i}" for i in range(60)] + [f"en/{i}" for i in range(40)] + [f"fr/{i}" for i in range(7)]
    got = verdicts(spark, paths, block)
    assert all(v == ("block" if p.startswith("de/") else "allow") for p, v in got.items())
    # nor are variable segments of which only a few have labels,
    got = verdicts(spark, [f"t/{i}" for i in range(100)], [urls.Rule("a.com/t/1", "block")])
    assert all(v == ("block" if p.startswith("t/1") else "allow") for p, v in got.items())
    # and a small labelled branch of a wide node isn't lost in it.
    paths = [f"w{i}/x" for i in range(3000)] + [f"bad/{i}" for i in range(1, 100)] + ["bad//x"] * 2
    rules = [urls.Rule("a.com/w", "allow"), *(urls.Rule(f"a.com/bad/{i}", "block") for i in range(1, 10))]
    got = verdicts(spark, paths, rules)
    assert got["bad//x"] == "block" and got["w77/x"] == "allow"


def test_op2_against_loops(spark):
    rows = [(r.page_id, r.url) for r in queries.table(spark, FOLDER, "pages").collect()]
    got = queries.REGISTRY["op2_url_filter"](spark, FOLDER).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, queries.URL_RULES)


ARTICLE = ["Title &amp; more", "First   part\n with <b>bold</b>&nbsp;words", "Second <a href='/x'>linked</a> part", "List"]
WANT = "Title & more\nFirst part with bold words\nSecond linked part\nList"


def page(number, parts=ARTICLE, extra="", side=True):
    first = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}" + ("</p>" if i % 2 else "") for i, p in enumerate(parts[1:]))
    menu = "".join(f"<li><a href=/{i}>entry {number} {i}</a>" for i in range(6))
    return (
        f"<!DOCTYPE html><html><head><title>t {number}</title><style>p{{}}</style><script>var t='</p>{number}';</script></head>"
        f"<body><nav><ul>{menu}</ul></nav><header>Site {number}</header>"
        f"<div class='cookie-notice'>We use cookies {number}</div><!-- <p>no</p> --><div id=main>"
        f"<div class='post'>{first}{extra}</div></div>"
        + (f"<aside><p>Side text {number} which is long, long and longer than all</p></aside>" if side else "")
        + f"<form><p>Name</p><input></form><section id='comments'><p>Reader {number} says</p></section>"
        f"<footer>&copy; {number}</footer></body></html>"
    )


@pytest.mark.parametrize(
    "names", ["no-sidebar page-1", "has-header", "single-post comment-open", "page search-results", "ad-free", "form-page", "widget ads"]
)
def test_names_of_the_page_frame_nothing(names):
    pages = [f"<html><body class='{names}'><article class='{names}'><p>text {i} of this</p></article></body></html>" for i in range(30)]
    path = html.region(html.infer(pages))
    assert [html.main_text(p, path) for p in pages] == [f"text {i} of this" for i in range(30)]


def test_names_must_be_borne_out():
    long = "many words about something that is said here at length, again and again, with no end in sight. " * 4
    head = "<h2 id='comments-on-policy'>On policy</h2><p class='alert'>Mind this</p><p id='social-impact'>It matters</p>"
    pages = [
        f"<body><div class='content share-enabled'><p>{long}{i}</p>{head}</div><div>x</div>"
        f"<div class='widget-area'><p>{i} by the way</p></div></body>"
        for i in range(12)
    ]
    want = [f"{long}{i}\nOn policy\nMind this\nIt matters" for i in range(12)]
    path = html.region(html.infer(pages))
    assert [html.main_text(p, path) for p in pages] == want
    # What holds nearly all of a page is no frame, whatever it is called; a section of plain text isn't one for its links.
    assert html.main_text(f"<body><div class='widget'><p>{long}</p></div></body>", None) == long.strip()
    part = f"<article><p>{long}</p><section id='social-impact'><p>{long}</p></section></article>"
    assert html.main_text(part, None) == f"{long.strip()}\n{long.strip()}"
    # Links, short notes and reader comments stay out, even many.
    menu = "<div class='related'>" + "<a href='/x'>some other article here</a>" * 20 + "</div>"
    said = "<div class='comments'>" + f"<p>{long}</p>" * 9 + "</div>"
    note = "<div class='cookie-notice'><p>We use cookies</p></div>"
    assert html.main_text(f"<body>{note}<div><p>{long}</p>{menu}</div>{said}</body>", None) == long.strip()


def test_wrapper_of_varied_pages():
    draw = random.Random(1)
    pages = [page(i, [f"Title {i}", *(f"words {draw.random()} of page {i}" for _ in range(draw.randint(2, 7)))], side=i % 2 == 0) for i in range(8)]
    wrapper = html.infer(pages)
    path = html.region(wrapper)
    assert path[-1] == "div post"
    assert html.main_text(page(99), path) == WANT
    body = next(c for c in wrapper.children[0].children if c.element.tag == "body")
    assert next(c for c in body.children if c.element.tag == "aside").optional
    post = next(c for c in body.children if c.element.label == "div main").children[0]
    assert [(c.element.tag, c.repeated) for c in post.children] == [("h1", False), ("p", True)]


@pytest.mark.parametrize("text", ["", "plain text", "<", "a < b", "<p>x", "</p></div>x", "<!-- x", "<script>x", "<p>a<br>b</p>&lt;i&gt;", "<p>cut <b"])
def test_odd_markup(text):
    want = {"plain text": "plain text", "<": "<", "a < b": "a < b", "<p>x": "x", "</p></div>x": "x", "<p>a<br>b</p>&lt;i&gt;": "a\nb\n<i>", "<p>cut <b": "cut"}
    assert html.main_text(text, ["html", "body"]) == want.get(text, "")


def test_extract_odd_rows(spark):
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(20)]
    rows += [(30, None, page(30)), (31, "http://b.org/", None), (32, "http://b.org/", ""), (None, "http://a.org/x", page(5)), rows[0]]
    rows += [(35, "http://c.org/2", "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>end")]
    rows += [(33, "http://c.org/", "<p>" * 3000 + "deep"), (34, "http://d.org/", "<article><p>" + "very long " * 90000 + "</article>")]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, text int, region string")
    got = html.extract(pages).collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    for r in got:
        want = {31: "", 32: "", 33: "deep", 35: "deep\nend", 34: "very long " * 89999 + "very long"}.get(r.page_id, WANT)
        assert r.text == want and r.n_chars == len(want)
    assert html.extract(pages.filter("false")).collect() == []


def test_op3_on_all_pages(spark):
    """The test pages mark their article, so a plain reading of that element is the right answer."""
    rows = {r.page_id: r for r in queries.table(spark, FOLDER, "pages").collect()}
    got = queries.REGISTRY["op3_html_text"](spark, FOLDER).collect()
    assert sorted(r.page_id for r in got) == sorted(rows)
    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", rows[r.page_id].html, re.S)
        cut = re.sub(r"<[^>]*(?:>|\Z)", lambda m: "" if re.match(r"</?b\b", m[0]) else "\n", article[1] if article else "")
        parts = [" ".join(html.unescape(x).split()) for x in cut.split("\n")]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def story(number, body):
    return f"<html><body><div class=top>Good day</div><div class=path>Home {number % 3}</div><main>{body}</main><div class=end>All rights</div></body></html>"


def test_rare_layouts_of_a_large_host(spark):
    """One page of 400 has two articles, one has its text beside the article; a sample of pages misses them."""
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(i, f"http://a.org/{i}", story(i, f"<article><p>{words(i)}</p><p>end {i}</p></article>")) for i in range(400)]
    want = {i: f"{words(i)}\nend {i}" for i in range(400)}
    rows[7] = (7, "http://a.org/7", story(7, "<article><p>one</p></article><article><p>two</p></article>"))
    rows[11] = (11, "http://a.org/11", story(11, f"<article><p>short</p></article><section><p>{words(11)}</p></section>"))
    want |= {7: "one\ntwo", 11: f"short\n{words(11)}"}
    rows += [(1000 + i, None, f"<div><p>{words(i)}</p></div>" if i else f"<div><p>{words(0)}</p></div><ul><li><p>{words(1)}</p></ul>") for i in range(13)]
    want |= {1000 + i: words(i) if i else f"{words(0)}\n{words(1)}" for i in range(13)}
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(20)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_merged_wrappers_hold_what_one_holds():
    draw = random.Random(3)
    pages = [page(i, [f"Title {i}", *(f"words {draw.random()}" for _ in range(draw.randint(2, 7)))], side=i % 2 == 0) for i in range(24)]
    whole, parts = html.infer(pages), [html.infer(pages[i::6]) for i in range(6)]
    for other in parts[1:]:
        html.merge(parts[0], html.unpacked(html.packed(other)))
    assert html.packed(parts[0])[2:8] == html.packed(whole)[2:8]
    assert parts[0].content() == whole.content() and html.regions(parts[0]) == html.regions(whole)


def test_names_of_their_own_on_every_page():
    pages = [f"<body><div id=top>Top</div><div id=post-{i}><h1>t {i}</h1><div><p>text {i}</p></div></div></body>" for i in range(600)]
    parts = [html.infer(pages[:300]), html.infer(pages[300:])]
    html.merge(*parts)
    assert parts[0].slots() < 20
    assert html.main_text(pages[5].replace("post-5", "post-x"), *html.regions(parts[0])).endswith("t 5\ntext 5")


def test_copies_of_a_page_count_once(spark):
    """Neither copies nor pages that differ in frames and markup alone hide where the articles are."""
    body = lambda i: f"<article><p>text {i} of some length</p><p>more {i}</p></article>"
    side = "<div class=extra><p>" + "the same on every page " * 5 + "</p></div>"
    rows = [(0, "http://a.org/0", story(0, side + body(0)))] * 30
    rows += [(i, f"http://a.org/{i}", story(i, side + body(i))) for i in (1, 2)]
    one = f"<div class=top>Hi</div><main>{body(9)}</main>"
    rows += [(10 + i, f"http://b.org/{i}", f"<body><nav>{i}</nav>{one}<!-- {i} --></body>") for i in range(3)]
    rows += [(20, "http://c.org/", f"<body><nav>0</nav>{one}</body>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(6)
    got = [(r.page_id, r.text) for r in html.extract(pages).collect()]
    assert len(got) == len(rows)
    for i, text in got:
        number = i if i < 10 else 9
        assert text == f"text {number} of some length\nmore {number}", i
    copies = [story(0, side + body(0))] * 50 + [story(i, side.replace("same", f"other{i}") + body(i)) for i in (1, 2)]
    frame = spark.createDataFrame([("http://d.org/", p) for p in copies], "url string, html string").repartition(7)
    assert [tuple(r) for r in html.wrappers(frame).collect()] == [tuple(r) for r in html.wrappers(frame.distinct()).collect()]
