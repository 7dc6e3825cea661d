import html
import json
import random
import re
import time
from collections import Counter

import pytest

from inkframe.llm import html_wrappers as w
from inkframe.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def tree(page):
    return w.expression(w.dom(w.tokens(page)), 1.0)


def of(page, *others):
    """The text that a wrapper of these pages gives for the first, with the template's texts counted as Spark counts them."""
    pages = list(dict.fromkeys(others or [page]))
    wrapper, seen = tree(pages[0]), Counter()
    for other in pages[1:]:
        wrapper = w.merged(wrapper, tree(other))
    for other in pages:
        found, open_ = set(), [w.dom(w.tokens(other))]
        while open_:
            for k in open_.pop().kids:
                if isinstance(k, w.Run):
                    found |= {x for t, _, p in k.pieces if not t.isspace() for x in ((p, None), (p, w.digest(t)))}
                else:
                    open_.append(k)
        seen.update(found)
    fixed = {x for x, n in seen.items() if x[1] and n >= w.AGREE and n >= w.SHARE * seen[x[0], None]}
    return w.Extractor(wrapper, fixed).text(page)


def flat(node, at=""):
    """Path: (optional, repeated, pages) of all nodes of a wrapper."""
    out = {}
    for k, kid in enumerate(node[w.KIDS]):
        path = f"{at}/{kid[w.KEY]}" + "'" * sum(x[w.KEY] == kid[w.KEY] for x in node[w.KIDS][:k])
        out[path] = tuple(kid[w.OPTIONAL:w.CHARS])
        out |= flat(kid, path)
    return out


def test_repeats_optionals_and_slots():
    a = "<div><h1>A</h1><p>same</p><ul><li>1</li><li>2</li></ul></div>"
    b = "<div><h1>B</h1><section><b>new</b></section><p>same</p><ul><li>1</li></ul></div>"
    got = flat(w.merged(tree(a), tree(b)))
    assert got["/<div>"] == (False, False, 2.0) and got["/<div>/<h1>/+/#"] == (False, False, 2.0)
    assert got["/<div>/<section>"] == (True, False, 1.0) and got["/<div>/+/<ul>/+/<li>"] == (False, True, 2.0)
    assert got["/<div>/+/<p>"] == (False, False, 2.0) and got["/<div>/+/<ul>/+"] == (False, True, 2.0)


def test_containers_are_told_apart_by_what_they_hold():
    """Neither names nor places tell these: an optional part before the article leaves the article and the footer in place."""
    a = "<div><ul><li><a>m</a></li></ul></div><div>Ad</div><div><h1>T</h1><p>x</p></div><div>Foot <a>l</a></div>"
    b = "<div><ul><li><a>m</a></li></ul></div><div><h1>T</h1><p>x</p><p>y</p></div><div>Foot <a>l</a></div>"
    got = w.merged(tree(a), tree(b))[w.KIDS]
    assert [(x[w.KEY], x[w.OPTIONAL], x[w.PAGES]) for x in got] == [("<div>", False, 2.0), ("<div>", True, 1.0), ("<div>", False, 2.0), ("<div>", False, 2.0)]


def template(rng, depth=0):
    """A random union-free expression: (tag, optional, repeated, children), children of one element having different tags."""
    tags = rng.sample(["div", "section", "center", "main", "td"], rng.randint(1, 3)) if depth < 3 else []
    return [(t, rng.random() < 0.3, rng.random() < 0.3, template(rng, depth + 1)) for t in tags]


def filled(rng, nodes, used, at=""):
    out = ""
    for tag, optional, repeated, kids in nodes:
        n = 0 if optional and rng.random() < 0.5 else rng.randint(1, 3) if repeated else 1
        if n:
            used.setdefault(f"{at}/<{tag}>", []).append(n)
        for _ in range(n):
            inner = filled(rng, kids, used, f"{at}/<{tag}>") if kids else f"<p>{rng.random()}</p>"
            out += f"<{tag}>" + (inner or "<p>only</p>") + f"</{tag}>"
    return out


def test_random_templates_are_found_in_any_order_and_grouping(monkeypatch):
    """A brute-force count of what was filled in tells which nodes there are, which are optional and on how many pages."""
    monkeypatch.setattr(w, "likeness", lambda *_: 1.0)  # tags alone tell the nodes here
    for seed in range(25):
        rng = random.Random(seed)
        nodes, pages, counts = template(rng), [], Counter()
        for _ in range(12):
            used = {}
            pages.append(f"<body>{filled(rng, nodes, used)}</body>")
            counts.update(used.keys())
        whole = [tree(p) for p in pages]
        shapes = []
        for _ in range(4):
            order = rng.sample(whole, len(whole))
            cut = rng.randint(1, 11)
            parts = []
            for part in (order[:cut], order[cut:]):
                x = part[0]
                for y in part[1:]:
                    x = w.merged(x, y)
                parts.append(json.loads(json.dumps(x)))
            shapes.append({p.removeprefix("/<body>"): v[2] for p, v in flat(w.merged(*parts)).items() if "+" not in p and p != "/<body>"})
        assert all(s == shapes[0] for s in shapes), seed
        assert shapes[0] == {p: float(n) for p, n in counts.items()}, seed


def test_merging_the_same_pages_again_adds_no_node():
    pages = ["<div><p>a</p><p>b</p></div>", "<div><p>c</p></div>", "<div><p>d</p><ol><li>x</ol></div>"]
    one = tree(pages[0])
    sizes = []
    for _ in range(3):
        for p in pages:
            one = w.merged(one, tree(p))
        sizes.append(len(flat(one)))
    assert sizes[0] == sizes[2] == 10


def test_nodes_go_by_their_support_alone():
    one = tree("<div><p>a</p></div>")
    for k in range(400):
        one = w.merged(one, tree("<div><p>a</p></div>" + (f"<section class=n{'abcdefghij'[k % 10]}{'xyz'[k % 3]}>q</section>" if k < 30 else "")))
    assert len(flat(one)) > 60 and len(flat(w.pruned(one, w.SUPPORT * one[w.PAGES]))) == 5


def test_article_without_what_surrounds_it():
    page = (
        "<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a='</p><article>'</script></head><body><header>Head</header>"
        "<nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><div class='ad big'>Buy</div><article><h1>T&auml;st &amp; more</h1><p>One  <b>bo</b>ld\n text.<br>Next"
        "<p>Two&nbsp;three<div class=\"newsletter\">Sign up</div><form><label>Name</label></form><aside>Aside</aside><ul><li>x<li>y</ul>"
        "<section id=comments><p>First!</p></section></article><div class=cookie-notice>Cookies</div><footer>&copy;</footer></body></html>"
    )
    assert of(page) == "Täst & more One bold text. Next Two three x y"


def test_without_article_the_varying_slots_are_the_text():
    page = "<body><div class=menu>M</div><div class=top>Site name</div><div class=post><h1>Title {0}</h1><p>Words {0}</div><div>All rights</div>"
    pages = [page.replace("{0}", str(k)) for k in range(12)]
    assert of(pages[3], *pages) == "Title 3 Words 3"
    assert of(pages[3]) == "Site name Title 3 Words 3 All rights"


def test_odd_markup():
    assert of("") == "" and of("plain  text") == "plain text" and of("a < b <") == "a < b <"
    assert of("<article>open <b>only") == "open only" and of("<p>x</p></div></article>y") == "x y"
    assert of("<article><a title='>'>q</a> &#x41;&lt;b&gt;</article>") == "q A<b>"
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert of(long) == " ".join(["word"] * 20_000)


@pytest.mark.parametrize("part", [
    "<div class='notice'>N</div>", "<div class='ad-slot'>N</div>", "<div class='ad-box'>N</div>", "<div class='share-bar'>N</div>", "<div class='related'>N</div>",
    "<div role='search'>N</div>", "<div role='alert'>N</div>", "<section id='comments-section'><p>N</p></section>", "<div class='user-comments'>N</div>",
    "<p hidden>N</p>", "<p HIDDEN=hidden>N</p>", "<p style='color:red; display : none'>N</p>", "<div style=\"visibility:hidden\">N</div>", "<span class=ad>N</span>",
    "<header><a href=/>N</a><nav>N</nav></header>", "<footer>N</footer>",
])
def test_parts_that_are_not_the_articles(spark, part):
    page = f"<article><h1>Title</h1><p>Words of it</p>{part}<p>and more</p></article>"
    rows = [(1, "http://a.example", page), (2, "http://b.example", page.replace("article>", "div>"))]
    got = w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Title Words of it and more"}


def test_what_only_looks_marked_stays():
    assert of("<article><header><h1>Head</h1><h2>Line</h2><a>menu</a></header><p title='a hidden gem'>Kept</p><p data-hidden=1>too</p></article>") == "Head Line Kept too"


def test_a_host_without_any_names(spark):
    """Given pages with every telling tag made a div, and without names: where the wrapper alone tells the article."""
    want, rows = {}, []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
        plain = re.sub(r"<(/?)(?:article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", r["html"])
        rows.append((r["page_id"], r["url"], re.sub(r"<div [^>]*>", "<div>", plain)))
    got = {r["page_id"]: r["text"] for r in w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    right = sum(got[k] == want[k] for k in want)
    assert right >= 0.97 * len(want), (right, len(want), [(k, got[k][-80:], want[k][-80:]) for k in want if got[k] != want[k]][:3])


def test_closing_tags_without_openers_and_deep_nesting_cost_little():
    began = time.time()
    assert of("<article>" + "</div>" * 100_000 + "x</article>") == "x"
    assert of("<div>" * 50_000 + "deep" + "</div>" * 50_000 + "<p>after") == "deep after"
    assert of("<div><p>" * 3_000 + "deep") == "deep"
    assert time.time() - began < 20


def test_many_children_are_aligned_by_name():
    pages = ["".join(f"<div class=c{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}>w{k}</div>" for k in range(n)) for n in (600, 590)]
    assert of(pages[0], *pages) == " ".join(f"w{k}" for k in range(600))


def test_pages(spark):
    rows = [
        (1, "http://h.example/1", "<article>one</article>", "x", "y"), (1, "http://h.example/1", "<article>one</article>", "x", "y"), (2, None, "<p>two</p>", "x", "y"),
        (3, "not an address", None, "x", "y"), (None, "http://H.example:80/2", "", "x", "y"), (4, "http://u@h.example", "<article>  </article>", "x", "y"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper string, host string")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in w.main_text(pages).collect()), key=repr)
    text = {1: "one", 2: "two"}
    assert got == sorted(((p, u, text.get(p, ""), len(text.get(p, ""))) for p, u, *_ in rows), key=repr)
    assert w.main_text(pages.limit(0)).count() == 0
    assert {r["h"] for r in pages.select(w.host().alias("h")).collect()} == {"h.example", None, "not an address"}


def test_salted_join_gives_the_same(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    one = sorted(map(tuple, w.main_text(pages).collect()))
    monkeypatch.setattr(w, "BROADCAST", -1)
    assert sorted(map(tuple, w.main_text(pages).collect())) == one


def test_query_against_the_articles_markup(spark):
    """The given pages hold one article each, of headings and paragraphs: their text can be read off plainly."""
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())
    assert {r["page_id"]: r["text"] for r in queries.BUILDS["op2_html_wrappers"](spark, SF_DIR).collect()} == want


def test_the_template_within_an_article_is_left_out(spark):
    page = "<body><article class=post><h1>Title {0}</h1><div class=intro>Thanks for reading us</div><p>Words {0}</p><p>Shared line</p></article>"
    rows = [(k, "http://a.example", page.replace("{0}", "abcdefghijkl"[k])) for k in range(12)]
    rows += [(20 + k, "http://copies.example", "<article><p>One page, copied</p></article>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title d Words d" and got[25] == "One page, copied"


def test_marks_are_whole_names():
    for page in (
        "<html class='ad-free'><body class='sidebar has-sidebar'><div class='content no-sidebar'><article><h2 id='social-impact'>Impact</h2>"
        "<section id='search-methods'><p class='notice-period'>Notice</p></section></article></div></body></html>",
        "<div class=sidebar><main><h2 id=footer>Impact</h2><p>Notice</p></main></div>",
    ):
        assert of(page) == "Impact Notice"
    post = "<div class=post><p>The post itself, which is long</p></div>"
    for comments in ("<article class='comment-body'>First!</article>", "<ol class=comments><li><article>First!</article></ol>", "<div class=sidebar><article>Teaser</article></div>"):
        assert of(post + comments) == "The post itself, which is long"


def test_every_page_counts_whatever_its_shape(spark):
    """Pages of differing blocks, whose union is far over 1,500 nodes, still show the footer that all share."""
    rows = [
        (k, "http://a.example", "<div class=top>Site name</div>" + "".join(f"<{t}><i>w{k} {n}</i></{t}>" for n, t in enumerate((["div", "ul", "dl", "ol", "pre"] * 80)[k % 5:200 + 17 * k])))
        for k in range(12)
    ]
    got = [r["text"] for r in w.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == 12 and all(t.startswith("w") and "Site name" not in t for t in got)
