"""Main text of pages: parsing, the network's gradients, given pages and held-out layouts."""

import html
import random
import re

import numpy as np
import pytest

from tidemark.llm import html_extract as he

FOLDER = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in he.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("plain  text\n", ["plain text"]),
        ("<p>a<p>b &amp; c&nbsp;d</p>e", ["a", "b & c d", "e"]),
        ("<p>a<b>b</b>c<br>d<i> e</i></p>", ["abc d e"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]),
        ("<script>var t='</p><p>no'</script>x<style>p{}</style>y<!-- <p>z -->", ["x", "y"]),
        ("a < b <3 </ p> c", ["a < b <3 c"]),
        ("<p>a<a href='x>y'>b</a><a href=\"", ["ab"]),
        ("<p>cut &am", ["cut &am"]),
        ("<p>cut &amp", ["cut &"]),
        ("<P CLASS=X>a</P><SCRIPT>no", ["a"]),
        ("</div></p>a</b><div>", ["a"]),
        ("<title>x <b>y</title><textarea><p>z</textarea>", ["x <b>y", "<p>z"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>" * 3000 + "deep" + "</div>" * 2999, ["deep"]),
        ("&#0;&#x41;&copy &notit;", ["�A© ¬it;"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_hold_the_names_of_all_ancestors_and_of_no_others():
    page = '<div class="site-nav"><p>a</p></div><article id=story><p>b<b>c<p>d</article><p>e'
    a, b, d, e = he.blocks(page)
    bit = lambda name: he._bit(name, he.PATH_BITS)
    assert a.path & bit("w nav") and a.path & bit("t div") and a.label == 0
    assert b.path == d.path | bit("t b") or b.path == d.path
    assert b.path & bit("w story") and b.label == d.label == 1
    assert e.path == bit("t p") and e.label == 0
    linked = he.blocks("<li><a href=x>abc</a> d</li>")[0]
    assert linked.links == 3


def test_reading_time_does_not_grow_with_the_square():
    import time

    t = time.time()
    for page in ("<" * 200_000, '<a "' * 50_000, "<p>" * 100_000 + "</b>" * 100_000, "<b>" * 50_000 + "<p>x" * 50_000):
        he.blocks(page)
    assert time.time() - t < 20


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = {"w": rng.standard_normal(6), "w0": np.zeros(1)}
    for side in "fb":
        net[side + "x"], net[side + "h"], net[side + "b"] = rng.standard_normal((5, 12)) * 0.5, rng.standard_normal((3, 12)) * 0.5, rng.standard_normal(12) * 0.1
    x, lengths = rng.standard_normal((2, 4, 5)), np.array([4, 2])
    inside = (np.arange(4)[None, :] < lengths[:, None])[:, :, None]

    def loss():
        h = np.concatenate((he._forward(net, "f", x).h, he._turned(he._forward(net, "b", he._turned(x, lengths)).h, lengths)), axis=2)
        return float(((h.astype(float) @ net["w"]) * inside[:, :, 0]).sum())

    f, b = he._forward(net, "f", x), he._forward(net, "b", he._turned(x, lengths))
    dh = inside * net["w"]
    grads = {k: np.zeros_like(v) for k, v in net.items()}
    he._backward(net, "f", x, f, dh[:, :, :3], grads)
    he._backward(net, "b", he._turned(x, lengths), b, he._turned(dh[:, :, 3:], lengths), grads)
    for key in ("fx", "fh", "fb", "bx", "bh", "bb"):
        at = tuple(int(rng.integers(n)) for n in net[key].shape)
        was = net[key][at]
        net[key][at] = was + 1e-2
        up = loss()
        net[key][at] = was - 1e-2
        down = loss()
        net[key][at] = was
        assert grads[key][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.fixture(scope="module")
def net(pages):
    return he.train(pages)


def plain_article(page):
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    inner = re.sub(r"</?(p|h1|br)[^>]*>", "\n", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_given_pages_give_their_articles(pages, net):
    urls = {r.page_id: r for r in pages.collect()}
    got = he.extract(pages, net).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r.text == plain_article(urls[r.page_id].html) and r.n_chars == len(r.text) and r.url == urls[r.page_id].url


def test_held_out_layouts(spark, net):
    """Texts of other pages, in containers and among parts that the markup rules don't name."""
    rng = random.Random(77)
    other = [he.blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id > 1000").limit(250).collect()]
    pool = [b.text for bs in other for b in bs]
    right = wrong = lost = whole = n = 0
    for own in other:
        content = [b.text for b in own if b.label == 1]
        page = he.blocks(he.laid_out(rng, content[0], content[1:20], pool))
        chosen = he.probabilities(net, [page])[0] >= 0.5
        wanted = np.array([b.label == 1 for b in page])
        right, wrong, lost = right + (chosen & wanted).sum(), wrong + (chosen & ~wanted).sum(), lost + (~chosen & wanted).sum()
        whole, n = whole + (chosen == wanted).all(), n + 1
    assert right / (right + wrong) > 0.96 and right / (right + lost) > 0.97 and whole / n > 0.8


def test_parts_around_and_inside_go(net):
    say = "Er stand an dem Fenster, sah hinaus und sagte nichts mehr zu ihr."
    page = (
        "<html><head><title>T</title></head><body><header><h2>The Paper</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>"
        f"<div class='cookie-notice'><p>We use cookies.</p></div><article><h1>Head</h1><p>{say}<aside class=related><a href=x>More</a></aside><p>{say} &lt;3"
        f"</article><section class='comments'><p>{say}</p><p>{say}</p></section><form><label>Mail</label><button>Go</button></form>"
        "<aside class=sidebar><p>Popular now</p></aside><footer>&copy; us</footer></body></html>"
    )
    assert he.main_text([he.blocks(page)], net) == [f"Head {say} {say} <3"]


def test_long_pages_are_read_in_chunks_with_the_same_result(net, monkeypatch):
    inner = "".join(f"<p>Paragraph {i}, with some words in it.</p>" for i in range(300))
    page = he.blocks(f"<nav><a href=x>a</a></nav><article><h1>H</h1>{inner}</article><footer>f</footer>")
    whole = he.probabilities(net, [page])[0]
    monkeypatch.setattr(he, "CHUNK", 37)
    assert np.allclose(he.probabilities(net, [page])[0], whole, atol=1e-4)


def test_odd_rows(spark, net):
    rows = [(1, None, None, 7), (2, "u", "", 7), (None, "v", "<article><p>a b c, d e f.</p></article>", 7), (2, "u", "", 7), (3, None, "<p>" * 9000, 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = he.extract(df, net).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got if not r.text) == [("1", "None", "", 0), ("2", "u", "", 0), ("2", "u", "", 0), ("3", "None", "", 0)]
    assert len(got) == 5
    none = df.limit(0)
    assert he.train(none) is None and he.extract(none, None).collect() == []
    assert he.extract(df, None).filter("text <> ''").count() == 0


def test_same_pages_give_the_same_network(pages, net):
    again = he.train(pages.repartition(7))
    assert all(np.array_equal(net[k], again[k]) for k in net)
