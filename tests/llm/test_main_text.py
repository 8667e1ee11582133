"""Main text against an independent parser; repeated runs against brute force."""

import html.parser
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from veilspan.llm import pages
from veilspan.llm.common import table
from veilspan.llm.queries import QUERIES


class Article(html.parser.HTMLParser):
    """Text of what lies inside <article>, a block for each block element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag in ("p", "h1", "h2", "li", "div", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth:
            self.blocks[-1] += data


def article(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    return "\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    want = {r.page_id: (r.url, article(r.html)) for r in table(spark, f"/root/testdata/sf{sf}", "pages").collect()}
    rows = QUERIES["op4_main_text"](spark, f"/root/testdata/sf{sf}").collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


@pytest.mark.parametrize("page,text", [
    ("<article><p>a &amp; b<br>c</p><nav>x</nav><p>d\n  e</article>", "a & b c\nd e"),
    ("<header>h</header><main><h1>t</h1><aside>s</aside><p>one <b>two</b></p></main><footer>f</footer>", "t\none two"),
    ("<main><div class='related'>r</div><article><header><h1>t</h1></header><p>x</article></main>", "t\nx"),
    ("<article>x<script>if (a < b) '</p>'</script>y<style>p{}</style></article>", "xy"),
    ("<article><p>x</p><section id=\"comments\"><article class=comment>no</article></section><p>z</article>", "x\nz"),
    ("<div class=\"cookie-notice\">accept</div><p title='a > b'>kept</p><form>f<input></form><div role=navigation>m</div>", "kept"),
    ("<div class=ad>buy</div><div>text<!-- <p>gone</p> --> more</div>", "text more"),
    ("plain text only", "plain text only"), ("", ""), ("<p>unclosed <b>bold", "unclosed bold"), ("<article><p>a<p>b<ul><li>c<li>d</ul></article>tail", "a\nb\nc\nd"),
    ("<article></article><p>outside", ""),
])
def test_structure(page, text):
    done, open_, _ = pages.split(page)
    assert (pages.unique([{"at": a, "text": t} for a, t in open_], set()) if done is None else done) == text


def brute_windows(streams):
    """Places that begin a run of RUN words found on another page."""
    where = defaultdict(set)
    for i, s in enumerate(streams):
        for k in range(len(s) - pages.RUN + 1):
            where[tuple(s[k:k + pages.RUN])].add(i)
    return {(i, k) for i, s in enumerate(streams) for k in range(len(s) - pages.RUN + 1) if len(where[tuple(s[k:k + pages.RUN])]) > 1}


def test_suffix_array():
    rng = random.Random(8)
    for alphabet in (1, 2, 3, 50):
        streams = [np.array([rng.randrange(alphabet) for _ in range(rng.randrange(40))], np.int64) for _ in range(12)]
        page, place, _, seen = pages.repeated(streams)
        assert {(p, k) for p, k, s in zip(page.tolist(), place.tolist(), seen) if s} == brute_windows([s.tolist() for s in streams])


@pytest.mark.parametrize("slice_chars", [8_000_000, 400])
def test_repeated_runs_go_and_unique_runs_stay(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(pages, "SLICE_CHARS", slice_chars)
    rng = random.Random(9)
    common = [" ".join(f"c{k}w{i}" for i in range(12)) for k in range(4)]
    rows, want = [], {}
    for i in range(60):
        own = [" ".join(f"p{i}x{rng.randrange(10**9)}" for _ in range(rng.randrange(1, 20))) for _ in range(3)]
        host = f"h{i % 2}.org"
        rows.append((i, f"https://{host}/{i}", f"<div>{own[0]}</div><div>{common[i % 2]}</div><div>{own[1]}</div><p>{common[2 + i % 2]} {own[2]}</p>"))
        want[i] = "\n".join(own)
    rows.append((99, "https://alone.org/", f"<div>{common[0]}</div>"))
    want[99] = common[0]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: (r.text, r.repeated_words) for r in pages.main_text(df).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert all(n == (0 if i == 99 else 24) for i, (_, n) in got.items())


@pytest.mark.parametrize("slice_chars", [8_000_000, 300])
def test_copies_count_once_and_shared_passages_go(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(pages, "SLICE_CHARS", slice_chars)
    text = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(3)]
    quote = " ".join(f"q{i}" for i in range(10))
    rows = [(i, f"https://a.org/{i % 7}", f"<div>{text[0]}</div>") for i in range(40)]
    rows += [(40, "https://a.org/print", f"<p>{text[0]}</p>"), (41, "https://b.org/", f"<div>{text[0]}</div>")]
    rows += [(50 + k, f"https://a.org/q{k}", f"<p>{text[k]}</p><p>{quote}</p>") for k in (1, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: (r.text, r.repeated_words) for r in pages.main_text(df).collect()}
    assert got == {i: (text[0], 0) for i in range(42)} | {50 + k: (text[k], 10) for k in (1, 2)}


@pytest.mark.parametrize("slice_chars", [8_000_000, 300])
def test_runs_choose_among_articles(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(pages, "SLICE_CHARS", slice_chars)
    card = "<article class=card><h2>{0}t {0}u</h2><p>{1}</p></article>"
    cards = [card.format(f"c{k}", " ".join(f"c{k}w{i}" for i in range(10))) for k in range(3)]
    own = [" ".join(f"p{k}w{i}" for i in range(40)) for k in range(9)]
    quote = " ".join(f"q{i}" for i in range(12))
    html = {
        # a teaser before or after the article, or beside text in no article
        0: f"{cards[0]}<article><p>{own[0]}</p></article>", 1: f"<article><p>{own[1]}</p></article>{cards[0]}{cards[1]}", 2: f"<div>{own[2]}</div>{cards[1]}",
        # a passage that articles share, an article of two versions with a footer of its own, two parts of one page
        3: f"<article><p>{quote}</p><p>{own[3]}</p></article>", 4: f"<article><p>{own[4]}</p><p>{quote}</p></article>",
        5: f"<article><p>{own[5]}</p></article><footer>one</footer>", 6: f"<article><p>{own[5]}</p></article><div>two of six</div>",
        7: f"<article><p>{own[6]}</p></article><article><p>{own[7]}</p></article>",
        # nothing but teasers: runs say nothing
        8: cards[0] + cards[2], 9: cards[2] + "<nav>menu</nav>" + cards[0],
        # two versions of a page of two articles
        10: f"<article>{own[8]}</article><article>{quote}</article>", 11: f"<article>{own[8].replace('w20', 'edited')}</article><article>{quote}</article>",
    }
    want = {0: own[0], 1: own[1], 2: own[2], 3: f"{quote}\n{own[3]}", 4: f"{own[4]}\n{quote}", 5: own[5], 6: own[5], 7: f"{own[6]}\n{own[7]}"}
    whole = [f"c{k}t c{k}u\n" + " ".join(f"c{k}w{i}" for i in range(10)) for k in range(3)]
    want |= {8: f"{whole[0]}\n{whole[2]}", 9: f"{whole[2]}\n{whole[0]}"}
    want |= {10: f"{own[8]}\n{quote}", 11: f"{own[8].replace('w20', 'edited')}\n{quote}"}
    rows = [(i, f"https://a.org/{i}", page) for i, page in html.items()] + [(20, "https://b.org/", html[0]), (21, "https://b.org/copy", html[0])]
    want |= {20: f"{whole[0]}\n{own[0]}", 21: f"{whole[0]}\n{own[0]}"}  # another host, on which nothing is repeated
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: (r.text, r.repeated_words) for r in pages.main_text(df).collect()}
    assert {i: t for i, (t, _) in got.items()} == want
    assert [got[i][1] for i in (0, 1, 2, 3, 4, 7, 20)] == [12, 24, 12, 12, 12, 0, 0]


def by_range(tables):
    """What of the tables meets: by range, then the answers by slice."""
    rows = pa.concat_tables(tables)
    met = [pages.shared_windows(rows.filter(pc.equal(rows["range"], r))) for r in pc.unique(rows["range"]).to_pylist()]
    return pa.concat_tables([*met, pages._table([], pages._MARKS)])


@pytest.mark.parametrize("short", [40, 3])
@pytest.mark.parametrize("slices", [1, 2, 5])
def test_slices_find_the_runs_of_the_host(monkeypatch, slices, short):
    monkeypatch.setattr(pages, "SHORT", short)
    rng = random.Random(11)
    texts = sorted({" ".join(rng.choice("ab") if i % 2 else rng.choice("abcdefghij") for i in range(rng.randrange(1, 40))) for _ in range(40)}) + [""]
    dealt = [[] for _ in range(slices)]
    for i, text in enumerate(texts):
        body = zlib.compress(f"-1\t{text}".encode() if text else b"")
        dealt[rng.randrange(slices)].append({"host": "h", "key": b"%d" % i, "form": b"%d" % i, "ids": [{"page_id": i, "url": None}], "body": body, "slices": slices})
    tables = {i: pa.Table.from_pylist([r | {"slice": i} for r in rows]) for i, rows in enumerate(dealt) if rows}
    marks = by_range([pages.slice_runs(t) for t in tables.values()])
    marks = by_range([pages.slice_windows(t, marks.filter(pc.equal(marks["slice"], i))) for i, t in tables.items()])
    got = {}
    for i, t in tables.items():
        for r in pages.slice_texts(t, marks.filter(pc.equal(marks["slice"], i))).to_pylist():
            got[r["ids"][0]["page_id"]] = r["text"], r["repeated_words"]
    streams = [t.split() for t in texts]
    gone = {(i, p) for i, k in brute_windows(streams) for p in range(k, k + pages.RUN)}
    own = [[w for p, w in enumerate(s) if (i, p) not in gone] for i, s in enumerate(streams)]
    assert got == {i: (" ".join(o), len(s) - len(o)) for i, (s, o) in enumerate(zip(streams, own))} and gone


def test_stretch():
    rng = random.Random(10)
    for _ in range(300):
        weights = [rng.randrange(-5, 6) for _ in range(rng.randrange(9))]
        sums = {(i, j): sum(weights[i:j]) for i in range(len(weights)) for j in range(i + 1, len(weights) + 1)}
        best = max(sums.values(), default=0)
        found = pages.stretch(weights)
        assert found == range(0) if best <= 0 else sums[found.start, found.stop] == best


def test_odd_tables(spark):
    rows = [(1, None, None, "t"), (1, "u", "<p>x", "t"), (1, "u", "<p>x", "t"), (None, "u", "<article>y", None), (2, "no scheme", " ", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in pages.main_text(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, "u", "x", 1), (1, "u", "x", 1), (None, "u", "y", 1), (2, "no scheme", "", 0)], key=str)
    assert pages.main_text(df.limit(0)).count() == 0


def test_odd_markup_is_linear():
    start = time.time()
    for unit in ("<a ", "<a \"", "<", "<!--", "<p>", "</p>", "<div>", "&amp;", "<a '\"", "<script>", "<b", "<div class='"):
        pages.split(unit * (200_000 // len(unit)))
    assert time.time() - start < 20
