"""Operators over pages and vectors: extraction, languages, archives, cover trees."""

import functools
import gzip
import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import covertree, html, language, warc

PAGES = "page_id long, url string, html string, text string, uid int, host string"


def frame(spark, data):
    return spark.createDataFrame([(i, u, h, "x", 1, "h") for i, u, h in data], PAGES)


def only(page):
    """The text of a page whose host has no other."""
    text, stream, may, prose = html.settle(page)
    return html.keep_unique(stream, may, prose, None)[0] if text is None else text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><body><nav>Menu</nav><article><h1>T</h1><p>a  b&amp;c<br>d<p>e</article><footer>f</footer>", "T a b&c d e"),
        ("<main><p>x</p><aside>no</aside><div class='ad'>no</div><div class='comments'><article>no</article></div></main><p>out</p>", "x"),
        ("<article><p>one <b>t</b>wo</p><form>no<input></form><script>if (a<b) x('</p>')</script><!-- <p>no --><ul><li>l1<li>l2</ul></article>", "one two l1 l2"),
        ("<article><p title='a>b'>q &lt;p&gt; &#233; &nbsp; z</p><div class=\"cookie-notice\">no</div><p hidden>no</p></article>", "q <p> é z"),
        ("<ARTICLE><P>up</P></ARTICLE><DIV>no</DIV>", "up"),
        ("<article><p class='ad'>no<p>yes</article>", "yes"),
        ("<article><textarea>no</textarea><p>a</p><section id='comments'><p>no</p></section></article>", "a"),
        ("<article>never closed <b>bold", "never closed bold"),
        ("", ""),
        ("<title>only a title</title>", ""),
        ("<article><p>a b c</p><div class='user-comments'>no</div><div id='newsletterBox'>no</div><section class='sponsored-content'>no</section></article>", "a b c"),
        ("<article><div role='banner'>no</div><p>a</p><ul class='share-buttons x'><li>no</ul><div role='search'>no</div><div class='ad_1'>no</div></article>", "a"),
        ("<article class='post comments-open has-sidebar'><p>a</p><article class='comment'>no</article><div itemscope itemtype='https://schema.org/Comment'>no</div></article>", "a"),
        ("<article class='post'><div class='entry-content comments-open'><p>a</p><p id='notice-2'>no</p><p class='noticed adverse'>b</p></div></article>", "a b"),
    ],
)
def test_markup(page, want):
    assert only(page) == want


def test_class_words_remove_nothing_else_within_an_article():
    page = '<article><div class="search-results">kept</div><p>an <b class="ad">inline</b> <i id="share">word</i></p><div class="related alert">also</div><div class="ad">gone</div></article>'
    assert only(page) == "kept an inline word also"


class Plain(HTMLParser):
    """Text of the blocks of well-formed pages, by the library's parser: what is in an article, and all of it."""

    def __init__(self):
        super().__init__()
        self.held, self.out, self.path = [], [], []

    def cut(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append(("article" in self.path, text))
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag not in ("b", "a", "meta"):
            self.cut()
            self.path.append(tag)

    def handle_endtag(self, tag):
        if tag in self.path:
            self.cut()
            del self.path[len(self.path) - 1 - self.path[::-1].index(tag) :]

    def handle_data(self, data):
        if not {"script", "style", "head"} & set(self.path):
            self.held.append(data)


def test_pages_against_the_library_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p.cut()
        want[r.page_id] = " ".join(t for inside, t in p.out if inside)
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == want


def test_repetition_alone_parts_text_from_boilerplate(spark):
    """Pages without any name, id or telling element: only the array can tell, and does."""
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    data, own, other = [], {}, {}
    for host in range(3):
        menu = [text(1) for _ in range(7)]
        notes = [text(14), text(9)]
        for k in range(20):
            i = 100 * host + k
            body = [text(40), text(25), text(6)]
            page = "".join(f"<div>{m}</div>" for m in menu) + f"<div>{notes[0]}</div>" + "".join(f"<div>{b}</div>" for b in body) + f"<div>{notes[1]}</div>"
            data.append((i, f"https://h{host}.example.org/{k}", f"<html><body><div>{page}</div></body></html>"))
            own[i], other[i] = body, [*menu, *notes]
    got = {r.page_id: r for r in html.extract(frame(spark, data).repartition(7)).collect()}
    assert {r.settled_by for r in got.values()} == {"repetition"}
    assert all(got[i].text == " ".join(own[i]) and got[i].n_repeated == len(other[i]) for i in own)


def brute_repeated(streams, run):
    """Token positions of each stream that some run covers which another stream holds too."""
    where = {}
    for i, t in streams.items():
        for a in range(len(t) - run + 1):
            where.setdefault(tuple(t[a : a + run]), set()).add(i)
    return {i: {x for a in range(len(t) - run + 1) if len(where[tuple(t[a : a + run])]) > 1 for x in range(a, a + run)} for i, t in streams.items()}


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_runs_against_brute_force(spark, chunk, monkeypatch):
    rnd = random.Random(chunk)
    monkeypatch.setattr(html, "_deal", functools.partial(html._deal, chunk=chunk))
    streams = {(h, i): [rnd.choice("abcd") for _ in range(rnd.randint(0, 60))] for h in "xy" for i in range(12)}
    for i in range(0, 12, 3):
        streams["x", i][5:5] = list("dcbadcbadd")
    ids = {k: n for n, k in enumerate(streams)}
    rows = [(ids[k], k[0], [" ".join(t[:7]), " ".join(t[7:])] if t else []) for k, t in streams.items()]
    found = html.repeated_runs(spark.createDataFrame(rows, "uid long, host string, blocks array<string>").repartition(4), run=6).collect()
    got = {r.uid: {x for s in r.spans for x in range(s.lo, s.hi)} for r in found}
    for h in "xy":
        for k, want in brute_repeated({k: t for k, t in streams.items() if k[0] == h}, 6).items():
            assert got.get(ids[k], set()) == want


def test_repeats_settle_pages_without_containers(spark):
    word = random.Random(3)
    text = lambda n: " ".join("".join(word.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    note, other = text(15), text(12)
    data, want = [], {}
    for i in range(30):
        body = [text(20), text(3)]
        host = f"h{i % 2}.example.com" if i < 28 else f"own{i}.example.com"
        data.append((i, f"http://{host}/{i}", f"<body><div>{note}</div><div>{body[0]}</div><p>{body[1]}</p><div>{other if i == 4 else ''}</div><footer>{note}</footer></body>"))
        keep = [note] * (i >= 28) + body + [other] * (i == 4)
        want[i] = " ".join(keep)
    shared = text(25)
    data += [(100 + i, "http://h0.example.com/x", f"<article><p>{shared}</p></article>") for i in range(3)]
    want |= {100 + i: shared for i in range(3)}
    data += [(200, None, None), (201, "http://h0.example.com/e", ""), (201, "http://h0.example.com/e", "")]
    out = html.extract(frame(spark, data).repartition(3))
    got = {r.page_id: r.text for r in out.collect()}
    assert {i: t for i, t in got.items() if i < 200} == want
    assert got[200] == got[201] == "" and out.count() == len(data)
    assert out.where("n_chars <> length(text)").count() == 0
    assert html.extract(frame(spark, data).where("false")).count() == 0


def test_boxes_of_articles_are_settled_by_repetition(spark):
    """A box without a telling name goes where the host's other pages have it too; prose and copied pages stay whole."""
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choice("klmnopqr") for _ in range(6)) for _ in range(n))
    page = lambda *parts: f"<body><article><h1>{parts[0]}</h1><p>{parts[1]}</p><div class='x7'>{parts[2]}</div><p>{parts[3]}</p></article></body>"
    shared, box, data, want = text(60), text(12), [], {}
    for i in range(24):
        head, end = text(4), text(30)
        own = text(12) if i % 4 == 0 else box
        data.append((i, f"http://h{i % 2}.example.com/{i}", page(head, shared, own, end)))
        want[i] = " ".join([head, shared] + [own] * (i % 4 == 0) + [end])
    copied = page(text(4), text(60), text(12), text(30))
    for i in (50, 51, 52):
        data.append((i, f"http://h0.example.com/{i}", copied))
    sections = "".join(f"<section id='s{k}'>{t}</section>" for k, t in enumerate([shared, box, text(9)]))  # all of the article is boxes: none is set off
    data.append((60, "http://h1.example.com/60", f"<article>{sections}</article>"))
    got = {r.page_id: r for r in html.extract(frame(spark, data).repartition(5)).collect()}
    assert {i: got[i].text for i in want} == want
    assert all(got[i].settled_by == ("shield" if i % 4 == 0 else "repetition") for i in want)
    assert len({got[i].text for i in (50, 51, 52)}) == 1 and len(got[50].text.split()) == 106
    assert got[60].text.split()[:60] == shared.split() and len(got[60].text.split()) == 81


def test_suffix_order():
    rnd = np.random.default_rng(1)
    t = rnd.integers(0, 4, 300).astype(np.uint64)
    at = np.arange(290)
    order, rank = html.suffix_order(t, at, 7)
    runs = [tuple(t[i : i + 7]) for i in at]
    assert [runs[i] for i in order] == sorted(runs)
    assert all((rank[i] == rank[j]) == (runs[i] == runs[j]) for i in range(0, 290, 7) for j in range(0, 290, 5))


def test_language(spark):
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the river and the stone with that", "en"), ("der fluss und das haus mit dem", "de"), ("le fleuve et la maison avec des", "fr"), ("?", None)] * 5)], "doc_id long, text string, lang string")
    page = lambda t, lang="": f"<html{lang}><body><article><p>{t}</p></article></body></html>"
    data = [(i, f"http://a.example.de/{i}", page("das haus und der fluss", ' lang="de-AT"')) for i in range(20)]
    data += [(50, "http://a.example.de/x", page("")), (51, "http://b.example.com/x", page("the stone and the river", ' lang="en"')), (52, None, None), (51, "http://b.example.com/x", page("the stone"))]
    pages = frame(spark, data)
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    assert got[3].lang == "de" and got[50].lang == "de" and got[51].lang == "en"
    assert got[50].text_lang is None and 0 < got[50].probability <= 1
    assert language.identify(pages, docs).count() == len(data)
    assert language.identify(pages.where("false"), docs).count() == 0
    assert {r.lang for r in language.identify(pages, docs.where("false")).collect()} == {None}


def test_language_is_declared_after_a_long_beginning():
    for start in ("<!--" + "x" * 70_000 + "-->", " " * 70_000, "<script>" + "y;" * 40_000 + "</script>"):
        assert html.declared(start + '<HTML class="a" lang="de"><body>') == "de"
    assert html.declared("<html " * 50_000) is None and html.declared("<html><body>") is None


def test_archives(spark, tmp_path):
    big = "x" * 1500 + "é"
    data = [(i, f"http://h/{i}?q=ä b", big) for i in (5, 3, 9)] + [(1, None, "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (9, "again", big), (7, "u", big + "y"), (None, "u", big)]
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame(spark, data).repartition(3)).collect())
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        ref = 9 if h == big and i != 9 else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if ref else "response", ref))
    assert got == sorted(want, key=str) or got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3], x[4] or 0))
    assert warc.round_trip(frame(spark, data).where("false")).count() == 0


def test_archive_files(spark, tmp_path):
    pages = frame(spark, [(i, f"http://h/{i}", f"page {i} " * 300) for i in range(40)]).coalesce(1)
    raw, own = f"file://{tmp_path}/raw", f"file://{tmp_path}/own"
    written = warc.write_monolithic(warc.mark(pages), raw, roll=20_000).collect()
    assert sum(r.records for r in written) == 40 and len(written) > 1
    one = gzip.decompress((tmp_path / "raw" / written[0].archive).read_bytes())
    assert one.count(b"WARC/1.1\r\n") == written[0].records
    done = warc.normalise(spark.createDataFrame(written), raw, own).collect()
    import json

    for r in done:
        data = (tmp_path / "own" / r.archive).read_bytes()
        lines = [json.loads(x) for x in (tmp_path / "own" / r["index"]).read_text().splitlines()]
        assert len(lines) == r.records and sum(x["length"] for x in lines) == len(data)
        assert all(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1") for x in lines)
    assert b"".join(gzip.decompress((tmp_path / "own" / r.archive).read_bytes()) for r in sorted(done, key=lambda r: r.records)).count(b"WARC/1.1\r\n") == 40


VECTORS = "vec_id long, embedding array<float>, label int, v int, block string"


@pytest.mark.parametrize(("block", "sample"), [(2000, 4000), (40, 60), (7, 20)])
def test_vectors(spark, block, sample):
    rnd = np.random.default_rng(block)
    data = []
    for label in (1, 2, None):
        base = rnd.normal(size=(12, 6))
        for k in range(120):
            x = base[k % 12] + rnd.normal(size=6) * (0.05 if k % 3 else 0.6)
            data.append(x.astype(np.float32).tolist())
    hot = rnd.normal(size=6)
    data += [(hot + rnd.normal(size=6) * 1e-4).astype(np.float32).tolist() for _ in range(150)]
    labels = [1] * 120 + [2] * 120 + [None] * 120 + [1] * 150
    rows = [(i, v, y, 0, "b") for i, (v, y) in enumerate(zip(data, labels, strict=True))]
    rows += [(1000, None, 1, 0, "b"), (1001, [0.0] * 6, 1, 0, "b"), (1002, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 1, 0, "b"), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 0, "b"), (1004, [], 1, 0, "b"), (1005, [float("inf")] + [0.0] * 5, 2, 0, "b"), (1006, data[0][:5], 1, 0, "b")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(spark.createDataFrame(rows, VECTORS), block=block, sample=sample).collect()}
    n = len(data)
    x = np.array(data, np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([-1 - i if v is None else v for i, v in enumerate(labels)])
    link = (x @ x.T >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(n)
    for _ in range(n):
        new = np.minimum(root, np.where(link, root[None, :], n).min(1))
        if (new == root).all():
            break
        root = new
    want = {i: (int(link[i].sum()), int(root[i]), int(root[i]) == i) for i in range(n)} | {i: (0, i, True) for i in range(1000, 1007)}
    assert got == want


@pytest.mark.parametrize(("dim", "spread"), [(3, 0.5), (8, 0.2), (64, 0.02), (64, 2.0)])
def test_levels_halve_and_nest(dim, spread):
    rnd = np.random.default_rng(dim)
    x = rnd.normal(size=(20, dim))[rnd.integers(0, 20, 700)] + spread * rnd.normal(size=(700, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] = x[6] = x[7]
    tree = covertree.CoverTree(x)
    for up, level in zip(tree.levels, tree.levels[1:], strict=False):
        assert level.bound <= up.bound / 2 and level.radius.max() <= level.bound
        assert set(up.centre) <= set(level.centre)
        assert (up.own == level.up[level.own]).all()
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[level.centre[level.own]])))
        assert (away <= level.radius[level.own] + 1e-7).all()
    other = covertree.CoverTree(x[::-1][:300] + 0.0)
    for b, same in ((tree, True), (other, False)):
        na, nb, edges = covertree.dual(tree, b, same, 0.93)
        link = tree.x @ b.x.T >= 0.93
        if same:
            np.fill_diagonal(link, False)
        assert (na == link.sum(1)).all() and (same or (nb == link.sum(0)).all())
        e = np.concatenate(edges) if edges else np.zeros((0, 2), int)
        e = e[e[:, 0] != e[:, 1]] if same else e
        assert link[e[:, 0], e[:, 1]].all()


def test_vectors_edges(spark):
    none = spark.createDataFrame([], VECTORS)
    assert covertree.near_duplicates(none).count() == 0
    two = spark.createDataFrame([(4, [1.0, 0.0], 1, 0, ""), (4, [2.0, 0.0], 1, 0, ""), (9, [1.0, 0.1], 1, 0, "")], VECTORS)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(two).collect())
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]
    assert covertree.near_duplicates(two.withColumn("label", F.lit(None).cast("int"))).where("n_links > 0").count() == 0


def test_very_long_pages(spark):
    body = " ".join(f"w{i}" for i in range(80_000))
    data = [(1, "http://h.example.com/1", f"<nav>menu</nav><article><p>{body}</p></article>"), (2, "http://h.example.com/2", f"<div>{body}</div><div>{'x' * 300_000}</div>")]
    got = {r.page_id: r.text for r in html.extract(frame(spark, data)).collect()}
    assert got == {1: body, 2: f"{body} {'x' * 300_000}"}
    back = {r.page_id: r for r in warc.round_trip(frame(spark, data)).collect()}
    assert {i: back[i].payload_digest for i in back} == {i: hashlib.sha1(h.encode()).hexdigest() for i, _, h in data}


@pytest.mark.parametrize("url", ["http://h/a%20b", "http://h/a%2Fb?x=%C3%A9", "http://h/ä b", "http://h/%", "u\nv", ""])
def test_urls_come_back_as_they_were(spark, url):
    assert [r.url for r in warc.round_trip(frame(spark, [(1, url, "x")])).collect()] == [url]


def test_ties_between_languages(spark):
    docs = spark.createDataFrame([(1, "aaa bbb", "xx"), (2, "aaa bbb", "aa")], "doc_id long, text string, lang string")
    got = language.identify(frame(spark, [(1, "http://h/1", "<article>aaa bbb</article>")]), docs).collect()
    # the text says either; the first by name counts for the host, whose share then speaks for it
    assert [(r.lang, r.text_lang) for r in got] == [("aa", "aa")] and 0.5 < got[0].probability < 1
