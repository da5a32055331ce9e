import gzip
import os
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import gif_media as G
from cadenza.llm import html_wrappers as H
from cadenza.llm import warc_revisits as W


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
def test_lzw_round_trip(data, depth):
    data = bytes(b & (1 << depth) - 1 for b in data)
    assert G.lzw_decode(G.lzw_encode(data, depth), depth, len(data)).tobytes() == data


@pytest.mark.parametrize("data", [os.urandom(64 * 900), bytes(64 * 2000), b"ab" * 64 * 900, bytes(range(256)) * 300])
def test_payload_round_trip(data):
    w, h, frames = G.parse(G.encode(data))
    assert w == 64 and b"".join(f.colours()[:, :, 0].tobytes() for f in frames) == data


def image(left, top, pixels, palette=None, interlace=False, transparent=None, disposal=0, delay=0):
    h, w = pixels.shape
    if interlace:
        pixels = pixels[np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])]
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay & 255, delay >> 8, transparent or 0, 0])
    bits = (0x80 | 1 if palette is not None else 0) | (0x40 if interlace else 0)
    head = b"," + b"".join(v.to_bytes(2, "little") for v in (left, top, w, h)) + bytes([bits])
    return control + head + (bytes(palette) if palette is not None else b"") + b"\x02" + G._blocks(G.lzw_encode(pixels.tobytes(), 2))


def test_drawing_rules():
    colours = [255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9]
    head = b"GIF89a" + (4).to_bytes(2, "little") + (8).to_bytes(2, "little") + bytes([0x81, 0, 0]) + bytes(colours)
    whole = np.zeros((8, 4), np.uint8)
    patch = np.array([[1, 2], [2, 1]], np.uint8)
    rows = np.repeat(np.arange(8, dtype=np.uint8)[:, None] % 4, 4, 1)
    data = head + image(0, 0, whole, delay=5) + image(1, 1, patch, transparent=2, disposal=2) + image(0, 0, patch, disposal=3) + image(2, 2, patch, palette=[1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]) + image(0, 0, rows, interlace=True) + b";"
    w, h, frames = G.parse(data)
    one, two, three, four, five = (f.canvas[:, :, :] for f in G.draw(w, h, frames))
    assert (w, h) == (4, 8) and (one[:, :, 0] == 255).all()
    assert two[1, 1].tolist() == [0, 255, 0, 255] and two[1, 2].tolist() == [255, 0, 0, 255]  # transparent: the frame before
    assert three[1, 1].tolist() == [0, 255, 0, 255] and three[2, 2].tolist() == [0, 0, 0, 0]  # disposal 2 cleared, then drawn
    assert four[0, 0].tolist() == [255, 0, 0, 255] and four[2, 2].tolist() == [2, 2, 2, 255]  # disposal 3 restored
    assert five[5, 0].tolist() == [0, 255, 0, 255] and five[2, 0].tolist() == [0, 0, 255, 255]
    assert frames[0].delay == 5 and G.histogram(one)[7] == 32
    for k in range(len(data)):
        G.parse(data[:k])  # a broken file ends early and never fails


def test_media_table(spark, documents, nothing, odd):
    stored = G.stored(documents)
    got = {r.doc_id: r for r in G.read_back(stored).collect()}
    for i, t in odd:
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(b), len(payload), zlib.crc32(payload[-64:]))
        media = G.encode(payload)
        assert (r.payload_sha256, r.media_bytes, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), len(media), hashlib.sha256(media).hexdigest())
        told = dict(x.split("=") for x in r.feature.split(";"))
        counts = [sum(x // 32 == k for x in payload) for k in range(8)]
        assert told["histogram"] == ",".join(map(str, counts)) and int(told["frames"]) == len(G.parse(media)[2]) and int(told["ms"]) >= 0
    frames = G.frames(stored, "doc_id").collect()
    assert all(len(r.histogram) == 24 for r in frames) and max(r.frame for r in frames) > 0
    assert G.read_back(G.stored(nothing)).count() == 0
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"GIF")], "doc_id long, media binary")
    assert G.frames(broken, "doc_id").count() == 0


PAGE = """<!doctype html><html><head><title>t</title><script>var a="</p><p>no";</script><style>p{}</style></head><body>
<nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">We use</div>{main}<aside>See also</aside>
<section id="comments"><p>First!</p></section><form><label>Name</label><button>Send</button></form><footer>&copy; x</footer></body></html>"""


def test_article(spark):
    main = "<article><h1>A &amp; B</h1><p>One<b> two</b>\n three<br>four<p>Caf&eacute; &#x1F600;<ul><li>i<li>j</ul><div class='share'>Tweet</div><!-- <p>no</p> --></article>"
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{main}", main), 7) for k in range(2)] + [(5, None, None, 7), (6, "http://h.example/e", "", 7)]
    out = {r.page_id: (r.text, r.n_chars) for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    want = "A & B\nOne two three four\nCafé 😀\ni\nj"
    assert out == {0: (want, len(want)), 1: (want, len(want)), 5: ("", 0), 6: ("", 0)}


def test_template_text_and_mass(spark):
    """Without an article element the wrapper decides: constant slots are the template's."""
    body = "<div class='wrap'><div class='top'>Same words on all pages</div><div class='text'><p>{0} first</p><p>{0} second</p></div></div>"
    rows = [(k, "https://T.example:80/x", PAGE.replace("{main}", body.format(f"page {k} has its own long text"))) for k in range(4)]
    out = H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.text for r in out.collect()} == {f"page {k} has its own long text first\npage {k} has its own long text second" for k in range(4)}


def test_wrapper_grammar():
    def stream(s):
        return H.fold(H.read(s))

    a, b = stream("<div><h1>x</h1><p>1</p><p>2</p></div>"), stream("<div><p>1</p><ul><li>a<li>b</ul></div>")
    assert H.expression(a) == "<div><h1>#</h1>(<p>#</p>)+</div>"
    assert H.expression(H.align(a, b)) == "<div>(<h1>#</h1>)?(<p>#</p>)+(<ul>(<li>#</li>)+</ul>)?</div>"
    assert H.align(a, a) == a
    deep = stream("<div>" * 3000 + "x" + "</div>" * 3000)
    assert H.expression(deep).count("#") == 1


def test_pages_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extracted(none).count() == 0 and W.resolved(W.records(W.captures(none))).count() == 0


def wrec(kind, key, uri, date, fields, status="200 OK", body=b"", profile=True):
    more = [("WARC-Profile", W.NOT_MODIFIED)] if kind == "revisit" and profile else []
    return W.record([("WARC-Type", kind), ("WARC-Record-ID", key), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", "application/http"), *more], W.http(status, fields, body))


def test_revisits(spark):
    t = "2024-01-01T00:00:0{}Z".format
    plain = b"".join([
        wrec("response", "r1", "http://www.A.example/p/?utm_x=1#f", t(1), [("ETag", '"1"'), ("Content-Type", "text/html"), ("X", "old")], body=b"one"),
        wrec("response", "r2", "https://a.example/p", t(3), [("ETag", '"2"'), ("Last-Modified", "L")], body=b"two"),
        wrec("response", "r3", "https://a.example/p", t(4), [], "404 Not Found"),
    ])
    zipped = b"".join(gzip.compress(x) for x in [
        wrec("revisit", "v0", "http://a.example/p", t(1), [("ETag", '"1"')]),
        wrec("revisit", "v1", "http://a.example/p", t(2), [("ETag", 'W/"1"'), ("X", "new"), ("Content-Type", "no")]),
        wrec("revisit", "v2", "http://a.example/p", t(5), [("ETag", '"1"')]),
        wrec("revisit", "v3", "http://a.example/p", t(6), [("Last-Modified", "L")]),
        wrec("revisit", "v4", "http://a.example/p", t(7), []),
        wrec("revisit", "v5", "http://other.example/", t(7), [("ETag", '"1"')]),
        wrec("revisit", "v6", "http://a.example/p", t(7), [("ETag", '"2"')], profile=False),
    ])
    files = spark.createDataFrame([(plain,), (zipped,), (None,), (b"",), (b"WARC/1.1 broken",), (plain[:40],)], "content binary")
    got = {r.record_id: r for r in W.resolved(W.records(files)).collect()}
    assert {k: (r.verdict, r.source_id) for k, r in got.items()} == {"v0": ("missing", None), "v1": ("resolved", "r1"), "v2": ("changed", "r2"), "v3": ("resolved", "r2"), "v4": ("unproven", "r2"), "v5": ("missing", None)}
    assert got["v1"].headers == {"etag": 'W/"1"', "content-type": "text/html", "x": "new"} and got["v1"].status == 200


def test_revisits_across_hours(spark):
    files = [(wrec("response", f"r{h}", "http://a.example/", f"2024-01-01T{h:02}:10:00Z", [("ETag", f'"{h}"')]),) for h in (1, 5)]
    files += [(wrec("revisit", f"v{h}", "http://a.example/", f"2024-01-01T{h:02}:05:00Z", [("ETag", '"1"')]),) for h in (1, 2, 5, 6)]
    got = {r.record_id: (r.verdict, r.source_id) for r in W.resolved(W.records(spark.createDataFrame(files, "content binary"))).collect()}
    assert got == {"v1": ("missing", None), "v2": ("resolved", "r1"), "v5": ("resolved", "r1"), "v6": ("changed", "r5")}


def texts_of(spark, sources):
    rows = [(k, "http://h.example/x", s) for k, s in enumerate(sources)]
    return {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_two_templates_of_a_host(spark):
    """The smaller template's pages keep their text, and so do pages with a class of their own."""
    long = [f"<body><div class=a><p>Long text number {k} that goes on and on and on</p></div><div class=b><p>All rights</p></div></body>" for k in range(6)]
    short = [f"<body><div class='c post-{k}'><p>Short {k}</p><p>End {k}</p></div><div class=b><p>All rights</p></div></body>" for k in range(3)]
    got = texts_of(spark, long + short)
    assert [got[k] for k in range(6)] == [f"Long text number {k} that goes on and on and on" for k in range(6)]
    assert [got[6 + k] for k in range(3)] == [f"Short {k}\nEnd {k}" for k in range(3)]


def test_numbered_classes_are_one_kind(spark):
    """A template text below a class that is another on each page is still the template's."""
    pages = [f"<body><div class='post-{k}'><h2>A heading that is much longer than the text is</h2><p>Text {k}</p></div></body>" for k in range(4)]
    assert texts_of(spark, pages) == {k: f"Text {k}" for k in range(4)}


def test_copies_of_a_page_keep_their_text(spark):
    one = "<body><div class=a><p>The same text</p></div></body>"
    assert set(texts_of(spark, [one] * 5).values()) == {"The same text"}


def article(*parts, body="<body>", main="<article>"):
    return f"<html>{body}{main}{''.join(parts)}</article></body></html>"


def test_names_of_states_and_of_the_page(spark):
    """Class words of body, html, article or main, and words of states, take nothing away; an article's own header stays."""
    got = texts_of(
        spark,
        [
            article("<p>One</p>", body="<body class='post no-sidebar'>"),
            article("<p>Two</p>", main="<article class='comments-open widget'>"),
            article("<header><h1>Three</h1></header><p>four</p><footer>by me</footer>"),
            "<body class='sidebar'><div class='has-sidebar'><p>Five</p></div><div class='site-footer'>no</div></body>",
            article("<p>Six <math><mi>x</mi></math> is</p><select><option>no<p>y</select><object>seven</object><p>eight"),
            article("<p>Nine</p><textarea><p>ten</p>"),
        ],
    )
    assert got == {0: "One", 1: "Two", 2: "Three\nfour", 3: "Five", 4: "Six x is\nseven\neight", 5: "Nine\nten"}


def test_lede_and_story_apart_from_each_other(spark):
    """Blocks of several elements make the text; what is constant or mostly links does not."""
    pages = [f"<body><div class=top>Same head</div><div class=lede><p>Lede {k}</p></div><div class=list><a href=x>Other page {k}</a></div><div class=story><p>Story {k} goes on</p></div></body>" for k in range(4)]
    assert texts_of(spark, pages) == {k: f"Lede {k}\nStory {k} goes on" for k in range(4)}


def test_the_wrapper_decides(spark):
    """One page within two hosts: its text follows from its place in each host's wrapper."""
    page = "<body><p>Welcome, all of you</p><h2>Title {0}</h2><p>Text {0}</p></body>"
    other = "<body><p>Intro {0}</p><h2>Title {0}</h2><p>Text {0}</p></body>"
    rows = [(k, "http://a.example/", page.format(k)) for k in range(4)] + [(10, "http://b.example/", page.format(0))] + [(10 + k, "http://b.example/", other.format(k)) for k in range(1, 4)]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Title 0\nText 0" and got[10] == "Welcome, all of you\nTitle 0\nText 0"
    # the second p is a slot of its own, though its path is that of the first; an optional part outside the required ones is left out
    promo = ["<body><div class=m><h2>T {0}</h2><p>X {0}</p></div>" + ("<div class=z><p>Buy {0}</p></div>" if k % 2 else "") + "</body>" for k in range(4)]
    assert texts_of(spark, [p.format(k) for k, p in enumerate(promo)]) == {k: f"T {k}\nX {k}" for k in range(4)}


def test_hostile_markup_is_read_in_line(spark):
    import time

    for piece in ("<a ", '<a "', "<a '\">", "<textarea>", "<!--", "<select><p>", "<", "<p class=", "<div>", "<nav><div>", "</div>", "<button>", "<li><td>"):
        began = time.time()
        H.fold(H.read("<p>x</p>" + piece * (1_000_000 // len(piece))))
        assert time.time() - began < (4 if piece in ("<select><p>", "<div>", "<nav><div>", "<li><td>") else 1.5), piece
    began = time.time()
    many = H.fold(H.read("<h2>a</h2><p>b</p>" * 4000))
    H.align(many, many)
    assert time.time() - began < 3


def test_a_host_is_folded_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(H, "FAN", 4)
    pages = [f"<body><div class={'abcdefghij'[k % 10]}><p>T {k}</p></div>" + "<ul><li>x</ul>" * (k // 10) + f"<h2>H {k}</h2></body>" for k in range(50)]
    got = texts_of(spark, pages)
    assert all(t.startswith(f"T {k}") and t.endswith(f"H {k}") for k, t in got.items()) and len(got) == 50


def test_slots_of_an_aligned_page():
    """Whatever streams a wrapper was made of, each of their pages finds a place for each of its blocks."""
    import random

    rng = random.Random(1)

    def made(depth=0):
        return "".join(f"<{t}>{made(depth + 1) if t == 'div' and depth < 3 else 'x'}</{t}>" for t in rng.choices(("p", "div", "h2", "ul"), k=rng.randrange(5)))

    for _ in range(40):
        trees = [H.read(made()) for _ in range(6)]
        tree = H.fold(trees[0])
        for t in trees[1:]:
            tree = H.align(tree, H.fold(t))
        wrapper = H.Wrapper(tree)
        assert all(slot >= 0 and wrapper.kind[slot] == "#" for t in trees for slot, _, _ in wrapper.slots(t))


def test_screens_and_images_of_hostile_size(spark):
    """A screen of 65535 by 65535 with a small image gives its frame; an image of that size ends the frames."""
    import struct

    def gif(left, top, w, h):
        head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6)
        return head + b"," + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02\x02\x4c\x01\x00;"

    media = spark.createDataFrame([(1, bytearray(gif(0, 0, 2, 2))), (2, bytearray(gif(0, 0, 65535, 65535))), (3, bytearray(gif(65533, 65533, 2, 2)))], "doc_id long, media binary")
    got = {r.doc_id: sum(r.histogram[:8]) for r in G.frames(media, "doc_id").collect()}
    assert got == {1: 4}


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randrange(1, 5)):
        node = ["#", f"t{rng.randrange(99)}", 0] if depth >= 3 or rng.random() < 0.45 else [rng.choice(["div", "section", "div.a", "p", "ul"]), *random_page(rng, depth + 1)]
        if not (out and out[-1][0] == node[0] == "#"):
            out.append(node)
    return out


def test_every_block_has_a_slot():
    """A page is a word of its host's wrapper, also where it was aligned with a later element of a kind."""
    import random

    from cadenza.llm import html_wrappers as H

    searched = 0
    for seed in range(600):
        rng = random.Random(seed)
        pages = [["", *random_page(rng)] for _ in range(rng.randrange(2, 7))]
        wrapper = None
        for page in pages:
            wrapper = H.fold(page) if wrapper is None else H.align(wrapper, H.fold(page))
        w = H.Wrapper(wrapper)
        for page in pages:
            slots = w.slots(page)
            assert all(slot >= 0 and w.kind[slot] == "#" for slot, _, _ in slots)
            searched += any(slot < 0 for slot, _, _ in w._matched(page, w._first))
    assert searched > 0


def test_long_lists_are_matched_in_line():
    """A page whose list is long, and whose elements were aligned with later ones of their kind."""
    import time

    from cadenza.llm import html_wrappers as H

    page = lambda first, n: ["", first, *(["div", ["p", ["#", f"t{k}", 0]]] if k % 2 else ["ul", ["li", ["#", f"t{k}", 0]]] for k in range(n))]
    one, two = page(["div", ["section", ["#", "a", 0]]], 4000), page(["h1", ["#", "b", 0]], 4000)
    w = H.Wrapper(H.align(H.fold(one), H.fold(two)))
    began = time.time()
    for p in (one, two, page(["h1", ["#", "b", 0]], 3000)):
        slots = w.slots(p)
        assert sum(slot < 0 for slot, _, _ in slots) == 0
    assert time.time() - began < 30


def test_wrapper_decides_inside_articles(spark):
    """What the host's pages share, or hold as links, goes from the article too; a page alone on its host keeps it."""
    from cadenza.llm import html_wrappers as H

    page = lambda k: f"<article><h1>Head {k}</h1><div class='promise'>We check all we print.</div><p>Text of {k} goes on.</p><ul class='more'><li><a href=x>Also of {k}</a></li><li><a href=y>And more {k}</a></li></ul></article>"
    rows = [(k, f"http://many.example/{k}", page(k)) for k in range(4)] + [(9, "http://one.example/9", page(9).replace("<ul", "<ol").replace("</ul", "</ol").replace("<a href=x>", "").replace("<a href=y>", "").replace("</a>", ""))]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Head {k}\nText of {k} goes on." for k in range(4))
    assert got[9] == "Head 9\nWe check all we print.\nText of 9 goes on.\nAlso of 9\nAnd more 9"
    same = [(k, "http://copies.example/a", page(1)) for k in range(5)]
    got = {r.text for r in H.extracted(spark.createDataFrame(same, "page_id long, url string, html string")).collect()}
    assert got == {"Head 1\nWe check all we print.\nText of 1 goes on."}


def test_captures_with_any_id(spark, tmp_path):
    """Ids beyond all dates, below 0 and missing, pages that repeat, and columns of the records' names."""
    from cadenza.llm import warc_revisits as W

    ids = [3 * 10**11 + 5, (1 << 63) - 1, -(1 << 63), -7, None, 4, 4]
    rows = [(i, f"http://h.example/{k // 2}", f"<p>{k // 2}</p>", "x", "y") for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, headers string").write.parquet(f"{tmp_path}/pages.parquet")
    got = W.op9_warc_revisits(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.date[:4] >= "1500" for r in got)
    assert sorted(r.record_id for r in got) == sorted(f"<urn:page:{i or 0}:revisit>" for i in ids)
