import pytest
import random

from riskloom.llm import pages


def host_page(i, body, notice="Please read our house rules before posting"):
    return (f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><div class='top'><p>House of pages</p></div>"
            f"<div class='box'><span>{notice}</span></div><div class='story'>{body}</div>"
            f"<footer>&copy; house {i}</footer></body></html>")


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", 1) for r in rows],
                                 "page_id long, url string, html string, host string, refs string, _html long")


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def test_elements_and_references():
    html = """<!DOCTYPE html><html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>menu</a></nav>
      <main><article class="post"><header><h1>T &amp; x</h1><p class="byline">by me</p></header>
      <p>a  b<br>c <a href="?a>b">link</a>&nbsp;&eacute;&#233;&#xe9;</p><script>var x = "</p><p>no";</script>
      <div class="notice">n</div><p>d<aside>s</aside><ul><li>one<li>two</ul><form>f<input></form>
      <table><tr><td>r1<td>r2<tr><td>r3</table><blockquote>q</blockquote><p>bold <b>x<p>next</b> y</p>
      <!-- <p>hidden</p> --><div hidden>h</div><div style="display: none">i</div><p>in<span class="ad">AD</span>line</p>
      <section id="comments"><p>c1</p></section></article><div class="ad-banner">x</div></main>
      <footer>f</footer></body></html>"""
    assert pages.main_text(html).split("\n\n") == [
        "T & x", "a b c link ééé", "d", "one", "two", "r1", "r2", "r3", "q", "bold x", "next y", "in", "line"]


def test_broken_html():
    for html, want in [("", ""), (None, ""), ("plain &lt;b&gt;\n text", "plain <b> text"), ("<p>a<p>b", "a\n\nb"),
                       ("</div></p>x<", "x<"), ("<article><p>cut off &am", "cut off &am"), ("<script>never ends", ""),
                       ("<div><p>1 < 2</p></div>", "1 < 2"), ("<!-- open", ""), ("<p></p>", "")]:
        assert pages.main_text(html) == want, html


def test_deep_and_long():
    deep = "<div>" * 900 + "<p>core</p>" + "</div>" * 900
    assert pages.main_text(deep) == "core"
    many = "".join(f"<p>par {i}</p>" for i in range(20_000))
    assert pages.main_text(f"<article>{many}</article>").count("\n\n") == 19_999


def test_wrapper_drops_constant_nodes(spark):
    """Without any telling element, what all pages of a host share is template."""
    rng = random.Random(2)
    rows = [(i, f"https://House.example/{i}", host_page(i, "".join(
        f"<p>{' '.join(rng.choice('abcdefgh') * rng.randint(2, 6) for _ in range(8))}</p>" for _ in range(rng.randint(1, 5)))))
        for i in range(40)]
    got = texts(pages.extract(rows_of(spark, rows)))
    for i, _, html in rows:
        body = html.split("class='story'>")[1].split("</div>")[0]
        assert got[i] == "\n\n".join(x.replace("<p>", "") for x in body.split("</p>") if x)


def test_copies_are_no_evidence(spark):
    """Copies of one page on a host do not turn its text into template."""
    page = "<body><article><h1>Title</h1><p>The only text</p></article></body>"
    rows = [(i, f"https://copies.example/{i}", page) for i in range(30)]
    assert set(texts(pages.extract(rows_of(spark, rows))).values()) == {"Title\n\nThe only text"}


def test_odd_rows(spark):
    page = "<article><p>x</p></article>"
    rows = [(1, None, page), (1, None, page), (2, "https://a.example/", None), (3, "/relative", ""), (None, "https://a.example/2", page),
            (None, None, None)]
    out = pages.extract(rows_of(spark, rows))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in out.collect()), key=repr)
    assert got == sorted([(i, u, "x" if h == page else "", 1 if h == page else 0) for i, u, h in rows], key=repr)
    assert pages.extract(rows_of(spark, [])).collect() == []


def all_matchings(a, ka, xs, b, kb, ys):
    """Size of the largest matching, by trying all."""
    if not xs or not ys:
        return 0
    best = max(all_matchings(a, ka, xs[1:], b, kb, ys), all_matchings(a, ka, xs, b, kb, ys[1:]))
    if a.label[xs[0]] == b.label[ys[0]]:
        best = max(best, 1 + all_matchings(a, ka, ka[xs[0]], b, kb, kb[ys[0]])
                   + all_matchings(a, ka, xs[1:], b, kb, ys[1:]))
    return best


def test_tree_matching_is_the_largest():
    rng = random.Random(9)

    def tree():
        depth, label = [], []

        def grow(d):
            for _ in range(rng.randint(0, 3)):
                depth.append(d)
                label.append(rng.choice("abc"))
                if d < 2:
                    grow(d + 1)

        grow(0)
        return pages.Shape(depth, label, [0] * len(label), [None] * len(label), [])

    for _ in range(60):
        a, b = tree(), tree()
        pairs = pages.tree_match(a, b)
        ka, kb = pages._kids(a.depth), pages._kids(b.depth)
        assert len(pairs) == all_matchings(a, ka, ka[-1], b, kb, kb[-1])
        assert all(a.label[x] == b.label[y] for x, y in pairs)
        order = sorted(pairs)
        assert [y for _, y in order] == sorted(y for _, y in pairs)


# ---- names, quotes, depth and short pages

@pytest.mark.parametrize("block", [
    "<div class='search-results-explained'>kept</div>", "<p class='form-of-government'>kept</p>",
    "<section id='related-work'>kept</section>", "<h2 class='social-history'>kept</h2>"])
def test_article_blocks_with_telling_words_stay(block):
    assert pages.main_text(f"<article>{block}<p>more</p></article>") == "kept\n\nmore"


@pytest.mark.parametrize("block", [
    "<div class='search'>gone</div>", "<p class='notice'>gone</p>", "<div class='site-footer'>gone</div>",
    "<div id='ad-slot-3'>gone</div>", "<section class='wide relatedPosts'>gone</section>",
    "<div class='cookie_banner'>gone</div>", "<span class='advert'>gone</span>"])
def test_named_furniture_goes(block):
    assert pages.main_text(f"<article><p>more</p>{block}</article>") == "more"


def test_quotes_in_tags():
    assert pages.main_text("<article><p class=it's>hello</p></article>") == "hello"
    assert pages.main_text("<article><p title=\"a > b\">hello</p><p data-x='1 > 0' id=y>you</p></article>") == "hello\n\nyou"
    assert pages.main_text("<article><p title=\"open>hello</p></article>") == "hello"
    assert pages._attributes(" class=it's id = \"a b\" hidden") == {"class": "it's", "id": "a b", "hidden": ""}


def test_very_deep_pages():
    def deep(i, n=4000):
        return "<div>" * n + f"<p>text {i}</p>" + "</div>" * n

    refs = [pages.shape_of(pages.parse(deep(i)))[0] for i in range(3)]
    wrapper = pages.Wrapper([r.dump() for r in refs])
    assert pages.main_text(deep(9), wrapper) == "text 9"
    assert len(pages.tree_match(refs[0], refs[1])) == len(refs[0].depth)


def test_template_of_short_pages():
    """Most of a short page is template, which is no sign of a copy."""
    def page(k):
        lines = "".join(f"<div class='t{i}'>line {i}</div>" for i in range(16))
        return f"<body>{lines}<div class='x1'>own {k}</div><div class='x2'>also {k}</div></body>"

    wrapper = pages.Wrapper([pages.shape_of(pages.parse(page(k)))[0].dump() for k in range(6)])
    assert pages.main_text(page(99), wrapper) == "own 99\n\nalso 99"
    # a reference that shares the page's own blocks is still a copy
    copies = pages.Wrapper([pages.shape_of(pages.parse(page(k)))[0].dump() for k in (1, 2, 99)])
    assert "own 99" in pages.main_text(page(99), copies)


# ---- counts over all pages of a host

def story(rng, n=6):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n * 3))


def counted_page(rng, box=None, by="by Ann", title=None):
    extra = f"<div class='c7'><span>{box}</span></div>" if box else ""
    body = "".join(f"<p>{story(rng)}</p>" for _ in range(rng.randint(2, 5)))
    return (f"<body><div class='w'><div class='h9'>{title or story(rng, 2)}</div><div class='b3'>{by}</div>{extra}"
            f"<div class='s1'>{body}</div></div></body>")


def test_a_constant_node_of_few_pages_is_template(spark):
    """A node on a tenth of the pages, mostly of one text, is found from the
    counts; a page with a text of its own there keeps it."""
    rng = random.Random(4)
    boxes = [("Own words" if i == 130 else "Tell your friends of us") if i % 10 == 0 else None for i in range(300)]
    rows = [(i, f"https://many.example/{i}", counted_page(rng, box=boxes[i], by=f"by {rng.choice(['Ann', 'Bo', 'Cy'])}"))
            for i in range(300)]
    got = texts(pages.extract(rows_of(spark, rows)))
    assert not any("Tell your friends" in t for t in got.values())
    assert "Own words" in got[130]
    assert all("by " in t for t in got.values())  # a text that varies between a few is content


def test_near_copies_count_once(spark):
    """A third of a host's pages share all but one paragraph: no template."""
    rng = random.Random(5)
    title, shared = story(rng, 2), "".join(f"<p>{story(rng)}</p>" for _ in range(9))
    copy = ("<body><div class='w'><div class='h9'>{t}</div><div class='b3'>by Ann</div><div class='s1'>{s}<p>{o}</p></div>"
            "</div></body>")
    rows = [(i, f"https://third.example/{i}", copy.format(t=title, s=shared, o=story(rng)) if i % 3 == 0
             else counted_page(rng)) for i in range(150)]
    got = texts(pages.extract(rows_of(spark, rows)))
    assert all(title in got[i] for i in range(0, 150, 3))
    assert not any("by Ann" in t for t in got.values())


def test_counts_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, f"https://{'ab'[i % 4 == 0]}.example/{i}", counted_page(rng, box="Box" if i % 3 else None)) for i in range(90)]
    df = rows_of(spark, rows)
    frames = pages.cut_lineage(pages.wrappers(df, "page_id", "url", "html"))
    wrappers = {r["host"]: pages.Wrapper(r["refs"]) for r in frames.collect()}
    seen = set()
    for _, url, html in rows:
        host = url.split("/")[2]
        frame, sign, said = wrappers[host].evidence(pages.shape_of(pages.parse(html))[0])
        seen |= {(host, frame, y, own, sign) for y, own in said}
    want = {}
    for host, frame, y, own, _ in seen:
        want.setdefault((host, frame, y), []).append(own)
    want = {k: next((t for t in set(v) if v.count(t) >= 0.9 * len(v)), None) for k, v in want.items() if len(v) >= 8}
    got = {(r["host"], x["frame"], x["node"]): x["own"]
           for r in pages.slots(df, frames, "url", "html").collect() for x in r["slots"]}
    assert got == want and any(v is not None for v in want.values()) and None in want.values()
