"""HTML extraction: an article element shields its text; a suffix array over each host finds the boilerplate around it.

A page is cut into blocks of visible text. The prose of an article (else of a main element) is
shielded: repetition never removes it, since articles share passages and the text is to be whole.
Not shielded is what an article sets off in a box: a block in an element with a class, id or role that
holds less than half of the article's words, if all such boxes together hold less than half.
All other blocks of all pages of a host are concatenated into token streams, each block led by a token
for its element, so that menus of single words have runs too. The suffixes of the streams are sorted,
and runs of at least `RUN` tokens that stand on two or more distinct pages of the host are boilerplate.
A block that such runs cover whole is repeated; a block with a run of its own stays whole. Pages of a
host with equal blocks are copies and count as one page, so a copied page keeps its text.

* A page with a shield: its text is the prose and, in their places, the boxes that the array leaves.
* A page without one: its text is the blocks that the array leaves, but for those that markup itself
  calls something else, for what stands on one page only, which no array can tell from text.

Markup calls a block something else by its element (nav, footer, form, ...), its role, a comment's
microdata, or a class name or id with a telling word and none but neutral words beside it: user-comments
and adBox go, search-results and comments-open stay. This holds in articles too.

White space is what the HTML standard calls so, and U+00A0 and the other spaces of Unicode (str.split).

Copies are known by 64 bits of a hash, as tokens are. Suffixes are dealt to buckets by the smallest hash in their first tokens, so a host with a third of
all pages spreads over many tasks; each task first settles what repeats among the pages it reads, and
sends one occurrence of it on. A bucket sorts its suffixes by prefix doubling.

Edge cases: null or empty html, and pages without text, give an empty text; a null url is a host of
its own; broken, unclosed and very long markup is read to its end; rows that repeat a page_id are
pages of their own; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, shuffle_partitions
from corpusmill.llm.substring import _mix, rolling, sliding_min

RUN, PIECE = 8, 3
_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_BOX = re.compile(r"(?:^|\s)(?:class|id|role)\s*=", re.I)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# fixed values: elements of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font hr i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Elements that are never article text, and those that aren't outside an article.
DROP = frozenset("head nav footer aside form noscript template dialog menu button select object svg math canvas audio video".split())
DROP_OUTSIDE = frozenset(["header"])
#: Words of class and id that name boilerplate; the second set counts outside an article only, the third beside a word of the others.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs "
    "banner masthead topbar toolbar footer comment comments disqus reply replies cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login "
    "share sharing social popup modal overlay pagination pager contentinfo complementary dialog".split()
)
NAMED_OUTSIDE = frozenset("header form alert related recommended search widget".split())
NEUTRAL = frozenset(
    "area article bar block body bottom box button buttons container content group holder icons inner inline item items left link links list page panel post reader readers "
    "right row section site slot text thread top unit user users widget wp wrap wrapper".split()
)
# fixed values: roles of parts of a page that are not its article
ROLES = frozenset("alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_WORD = re.compile(r"[a-z]+|[0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMENT = re.compile(r"(?:^|[/ ])(?:comment|usercomments?)(?= |$)", re.I)
_REMARK = frozenset("comment comments reply replies".split())
SAME_CLOSES = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select datalist"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTR.finditer(text)} if text.strip(" /\n\t") else {}


def _kind(name: str, attrs: str, inside: bool) -> int:
    """1: boilerplate, 2: article, 3: main, 0: neither."""
    if name in DROP or (name in DROP_OUTSIDE and not inside):
        return 1
    got = _attributes(attrs) if attrs else {}
    if got:
        named = _HUMP.sub("-", f"{got.get('class', '')} {got.get('id', '')}").lower()
        if name not in ("html", "body", "main") and (name not in INLINE or "comment" in named):
            if ROLES.intersection(got.get("role", "").lower().split()) or _COMMENT.search(f"{got.get('itemtype', '')} {got.get('itemprop', '')}"):
                return 1
            # an article's own names tell of its text, but for a reader's comment
            telling = _REMARK if name == "article" else NAMED if inside else NAMED | NAMED_OUTSIDE
            for words in map(_WORD.findall, named.split()):
                if any(w in telling for w in words) and all(w in telling or w in NEUTRAL or w.isdigit() for w in words):
                    return 1
        if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
            return 1
        if got.get("role") == "main":
            return 3
        if got.get("role") == "article" or got.get("itemprop") == "articleBody":
            return 2
    return {"article": 2, "main": 3}.get(name, 0)


def blocks(page: str) -> list[tuple[int, str, str, tuple[int, ...]]]:
    """(zone, element, text, boxes) in page order; zone 2: in an article, 3: in a main element, 0: elsewhere, 1: boilerplate by markup.

    boxes: the elements with a class, id or role within the article (or main element) that the block stands in, as numbers.
    """
    out: list[tuple[int, str, str, tuple[int, ...]]] = []
    held: list[str] = []
    stack: list[tuple[str, int, int]] = []
    depth = [0, 0, 0, 0]
    zone = at = 0

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((zone, next((n for n, _, _ in reversed(stack) if n not in INLINE), ""), text, tuple(b for _, _, b in stack if b)))
            held.clear()

    def pop_to(i: int) -> None:
        for _, k, _ in stack[i:]:
            depth[k] -= 1
        del stack[i:]

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        end = m.start() if m else size
        if end > at:
            text = page[at:end]
            held.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name in ("br", "hr"):
            held.append(" ")
            continue
        if name in VOID:
            continue
        if closing:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if i is None:
                if name not in INLINE:
                    flush()
                continue
            if name not in INLINE or any(k for _, k, _ in stack[i:]):
                flush()
            pop_to(i)
        else:
            kind = _kind(name, attrs, depth[2] + depth[3] > 0)
            if name not in INLINE or kind:
                flush()
            if name in CLOSES_P:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or (stack[i][0] not in INLINE)), None)
                if i is not None and stack[i][0] == "p":
                    pop_to(i)
            elif name in SAME_CLOSES:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name or stack[i][0] in SAME_CLOSES[name].split()), None)
                if i is not None and stack[i][0] == name:
                    pop_to(i)
            if not attrs.endswith("/") or name not in ("svg", "math"):
                boxed = kind == 0 and depth[2] + depth[3] > 0 and name not in INLINE and _BOX.search(attrs)
                stack.append((name, kind, m.start() if boxed else 0))
                depth[kind] += 1
        zone = 1 if depth[1] else 2 if depth[2] else 3 if depth[3] else 0
    flush()
    return out


def declared(page: str) -> str | None:
    """The lang attribute of the html element."""
    m = re.search(r"<html\b", page, re.I)
    end = page.find(">", m.end()) if m else -1
    return _attributes(page[m.end() : end]).get("lang") if end >= 0 else None


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def set_off(own: list[tuple[str, tuple[int, ...]]]) -> list[bool]:
    """Which of an article's (text, boxes) stand in a box of less than half of its words; none if these are half of it together."""
    sizes = [len(t.split()) for t, _ in own]
    held: dict[int, int] = {}
    for n, (_, boxes) in zip(sizes, own, strict=True):
        for b in boxes:
            held[b] = held.get(b, 0) + n
    off = [any(2 * held[b] < sum(sizes) for b in boxes) for _, boxes in own]
    return off if 2 * sum(n for n, o in zip(sizes, off, strict=True) if o) < sum(sizes) else [False] * len(own)


def settle(page: str) -> tuple[str | None, list[str], list[bool], list[str] | None]:
    """(text, or None where the array is asked; blocks of the host's stream, each led by its element's mark; which of them may be text; the prose before each of them and at the end, where there is a shield)."""
    got = blocks(page)
    own = next((z for z in (2, 3) if any(b[0] == z for b in got)), None)
    off = iter(set_off([(t, boxes) for z, _, t, boxes in got if z == own]))
    stream, may, prose = [], [], [""]
    for z, e, t, _ in got:
        if z == own and not next(off):
            prose[-1] += f" {t}" if prose[-1] else t
        else:
            stream.append(f"\0{e} {t}")
            may.append(z == own or (own is None and z == 0))
            prose.append("")
    if any(may):
        return None, stream, may, None if own is None else prose
    return " ".join(filter(None, prose)), stream, [], None


def _copy(host: str, got: tuple) -> int:
    """A number for a page of a host that its copies have too."""
    name = xxhash.xxh3_64(host)
    for part in (got[3] or [got[0] or ""]) + got[1]:
        name.update("\1" + part)
    return name.intdigest() - (1 << 63)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            got = [settle(h or "") for h in part.column(2).to_pylist()]
            hosts = [host_of(u) for u in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(_copy, hosts, got), pa.int64()), part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.list_(pa.bool_())), pa.array([g[3] for g in got], pa.list_(pa.string())),
                ],
                names=["uid", "page_id", "url", "host", "text", "blocks", "open", "prose"],
            )


def suffix_order(tokens: np.ndarray, at: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): the suffixes that start at `at`, sorted by their first `run` tokens, and the rank of each; equal ranks: equal runs.

    Prefix doubling: ranks of runs of 1, 2, 4, ... tokens, each from a pair of the ranks before it.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < run:
        step = min(have, run - have)
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: len(rank) - step] = rank[step:]
        rank = np.unique(rank * (rank.max() + 2) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    order = np.argsort(rank[at], kind="stable")
    return order, rank[at]


def _shared(rank: np.ndarray, order: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which suffixes have an equal run on another page."""
    r, p = rank[order], page[order]
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(p, begin) != np.maximum.reduceat(p, begin) if len(r) else np.zeros(0, bool)
    out = np.zeros(len(rank), bool)
    out[order] = np.repeat(many, np.diff(np.append(begin, len(r))))
    return out


_SCHEMA = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("tokens", pa.binary())])


def _deal(buckets: int, run: int, chunk: int = 1 << 20):
    """Suffix runs of a chunk of pages: settled spans, and for the rest the tokens from lo on that a bucket needs."""

    def work(pages: list[tuple[int, str, list[str]]]) -> Iterator[tuple]:
        pages = list({p[0]: p for p in pages}.values())  # copies are one page
        tokens, owner, start = [], [], []
        for i, (_, host, texts) in enumerate(pages):
            own = [xxhash.xxh3_64_intdigest(w, seed=len(host)) ^ xxhash.xxh3_64_intdigest(host) for t in texts for w in t.split()]
            tokens += own
            owner += [i] * len(own)
            start.append(len(own))
        if len(tokens) < run:
            return
        t, of = np.array(tokens, np.uint64), np.array(owner)
        begin = np.concatenate([[0], np.cumsum(start)[:-1]])
        end = np.cumsum(start)
        at = np.flatnonzero(np.arange(len(t)) + run <= end[of])
        if not len(at):
            return
        order, rank = suffix_order(t, at, run)
        shared = _shared(rank, order, of[at])
        for lo, hi in _stretches(at[shared], of):
            yield 0, True, pages[of[lo]][0], lo - begin[of[lo]], hi - begin[of[lo]] + run, b""
        # one occurrence of a shared run is enough for other chunks; all of what stands on one page
        first = np.zeros(len(at), bool)
        first[order[np.concatenate([[True], rank[order][1:] != rank[order][:-1]])]] = True
        go = at[~shared | first]
        low = sliding_min(rolling(t, PIECE), run - PIECE + 1)
        for lo, hi in _stretches(go, of, low):
            i = of[lo]
            yield int(_mix(low[lo : lo + 1], low[lo : lo + 1])[0] % np.uint64(buckets)), False, pages[i][0], lo - begin[i], hi - begin[i] + run, t[lo : hi + run].tobytes()

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(work(held))
            for x in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, s) for c, s in zip(zip(*rows[x : x + 20_000], strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                size += sum(map(len, row[2]))
                if size >= chunk:
                    yield from flush()
                    held, size = [], 0
        yield from flush()

    return run_all


def _stretches(at: np.ndarray, of: np.ndarray, value: np.ndarray | None = None) -> list[tuple[int, int]]:
    """First and last of consecutive starts on one page (and of one value)."""
    if not len(at):
        return []
    new = (np.diff(at) != 1) | (np.diff(of[at]) != 0)
    if value is not None:
        new |= value[at[1:]] != value[at[:-1]]
    cut = np.flatnonzero(new) + 1
    return list(zip(at[np.concatenate([[0], cut])].tolist(), at[np.concatenate([cut - 1, [len(at) - 1]])].tolist(), strict=True))


_SPANS = pa.schema([("uid", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _collect(run: int):
    def work(rows: pa.Table) -> pa.Table:
        done = rows.column("settled").to_numpy()
        uid, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("uid", "lo", "hi"))
        out = [np.stack([uid[done], lo[done], hi[done]], 1)]
        u, low, high = uid[~done], lo[~done], hi[~done]
        if len(u):
            t = np.frombuffer(b"".join(rows.column("tokens").filter(pa.array(~done)).to_pylist()), np.uint64)
            n = high - low
            base = np.cumsum(n) - n
            row = np.repeat(np.arange(len(u)), n - run + 1)
            each = np.arange(len(row)) - np.repeat(np.cumsum(n - run + 1) - (n - run + 1), n - run + 1)
            at = base[row] + each
            order, rank = suffix_order(t, at, run)
            hit = np.flatnonzero(_shared(rank, order, u[row]))
            if len(hit):
                cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(row[hit]) != 0)) + 1
                a, b = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut - 1, [len(hit) - 1]])]
                out.append(np.stack([u[row[a]], low[row[a]] + each[a], low[row[b]] + each[b] + run], 1))
        got = np.concatenate(out)
        return pa.Table.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1].astype(np.int32)), pa.array(got[:, 2].astype(np.int32))], schema=_SPANS)

    return work


def repeated_runs(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(uid, spans): token spans of each stream that stand on another page of the host too. pages: uid, host, blocks."""
    buckets = 4 * shuffle_partitions(pages.sparkSession)
    dealt = pages.select("uid", "host", "blocks").mapInArrow(_deal(buckets, run), "bucket int, settled boolean, uid long, lo int, hi int, tokens binary")
    dealt = dealt.withColumn("bucket", F.when(F.col("settled"), F.pmod(F.hash("uid", "lo"), F.lit(buckets))).otherwise(F.col("bucket")))
    found = dealt.groupBy("bucket").applyInArrow(_collect(run), "uid long, lo int, hi int")
    return found.groupBy("uid").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))


def keep_unique(texts: list[str], open_: list[bool], prose: list[str] | None, spans: list[dict] | None) -> tuple[str, int, int, int]:
    """(the prose, and in their places the open blocks that repeated runs do not cover whole; blocks that they cover; open ones of these; other blocks that go by their markup)."""
    sizes = [len(t.split()) for t in texts]
    covered = np.zeros(sum(sizes) + 1, bool)
    for s in spans or ():
        covered[s["lo"] : s["hi"]] = True
    prose = prose or [""] * (len(texts) + 1)
    out, at, repeated, decided, named = [], 0, 0, 0, 0
    for text, is_open, n, before in zip(texts, open_, sizes, prose, strict=False):
        out.append(before)
        if covered[at : at + n].all():
            repeated += 1
            decided += is_open
        elif is_open:
            out.append(text[text.index(" ") + 1 :])
        else:
            named += 1
        at += n
    return " ".join(filter(None, [*out, prose[-1]])), repeated, decided, named


def extract(pages: DataFrame, run: int = RUN) -> DataFrame:
    """page_id, url, text, n_chars, host, settled_by, n_repeated, n_named for every page row.

    settled_by: shield (an article or main element, of which the array removed nothing), repetition (the
    array removed a block), else markup. n_repeated, null where the array was not asked: blocks that it finds
    on other pages of the host, and n_named those that only their markup tells from text.
    """
    rows = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = materialise(
        rows.mapInArrow(_parse, f"uid long, page_id {kind}, url string, host string, text string, blocks array<string>, open array<boolean>, prose array<string>"), "pages"
    )
    shielded = parsed.where("text is not null").selectExpr("page_id", "url", "text", "host", "if(text = '', 'markup', 'shield') as settled_by", "cast(null as int) as n_repeated", "cast(null as int) as n_named")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prose = b.column("prose").to_pylist()
            got = [keep_unique(*x) for x in zip(b.column("blocks").to_pylist(), b.column("open").to_pylist(), prose, b.column("spans").to_pylist(), strict=True)]
            by = [("repetition" if g[2] else "shield") if p else ("repetition" if g[1] else "markup") for g, p in zip(got, prose, strict=True)]
            text, repeated, named = (pa.array([g[i] for g in got], t) for i, t in ((0, pa.string()), (1, pa.int32()), (3, pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), text, b.column("host"), pa.array(by, pa.string()), repeated, named], names=["page_id", "url", "text", "host", "settled_by", "n_repeated", "n_named"])

    rest = parsed.where("text is null").join(repeated_runs(parsed, run), "uid", "left")
    rest = rest.mapInArrow(work, f"page_id {kind}, url string, text string, host string, settled_by string, n_repeated int, n_named int")
    return shielded.union(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "host", "settled_by", "n_repeated", "n_named")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars", "settled_by", "n_repeated", "n_named")
