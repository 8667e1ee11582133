"""Pages to elements."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from veilspan.operators import detect
from veilspan.sources import pages as pg

HTML = """<!DOCTYPE html><html><head><title>T <b>x</b></title></head><body class="a">
<!-- <input name="commented"> --><script>var t = "<input name='scripted'>";</script>
<label for="m">Mobile &amp; home</label><INPUT ID=m TYPE=tel value='+91 98765 43210' class="c d">
<label>Full name <input name="n" autocomplete="name"></label>
<textarea name="t">42 &lt;MG&gt; Road</textarea>
<select name="s" title="Plan"><option>Gold</option><option>Silver</option></select>
<input type="password" value="2345 6789 0123">
<div style="display : none">gone</div><p hidden>gone too</p><p data-hidden="1">stays</p>
<a href="">no target</a><a href="/x">go &amp; see</a><a href="/y"> </a>
<img src="/img/passport.png" alt="scan"><img src="logo.png"><div></div><span></span><br>
</body></html>"""


def rows(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return pg.elements(df).orderBy("uid").collect()


def test_elements(spark):
    got = rows(spark, HTML)
    assert [r["role"] for r in got] == [
        "element", "input", "element", "input", "textarea", "select", "input", "element", "element", "link", "img", "img", "element",
    ]
    by_name = {r["name"]: r for r in got if r["name"]}
    tel = next(r for r in got if r["input_type"] == "tel")
    assert (tel["label"], tel["id"], tel["value"], tel["class_name"]) == ("Mobile & home", "m", "+91 98765 43210", "c d")
    assert by_name["n"]["label"] == "Full name" and by_name["n"]["input_type"] == "text"
    assert by_name["t"]["value"] == "42 <MG> Road"
    assert (by_name["s"]["text"], by_name["s"]["label"]) == ("Gold Silver", "Plan")
    assert not {"commented", "scripted"} & set(by_name)
    texts = [r["text"] for r in got if r["text"]]
    assert "gone" not in texts and "gone too" not in texts and "stays" in texts and "go & see" in texts
    assert [r["src"] for r in got if r["role"] == "img"] == ["/img/passport.png", "logo.png"]


def test_password_values_are_not_scanned(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    found = [(r["category"], r["source"]) for r in detect.page_detections(df).orderBy("uid", "det_no").collect()]
    assert ("aadhaar", "text") not in found
    assert ("password", "type") in found and ("document_image", "image") in found and ("phone", "text") in found


def test_empty_containers_stop_after_200(spark):
    html = "<body>" + "<div></div>" * 300 + "<p>text</p>" * 3 + "</body>"
    got = rows(spark, html)
    assert sum(r["tag"] == "div" for r in got) == 201
    assert sum(r["tag"] == "p" for r in got) == 3


def test_caps_are_marked_not_cut(spark):
    html = "<body>" + "<p>text</p>" * 2100 + "</body>"
    got = rows(spark, html)
    assert len(got) == 2100 and sum(r["in_cap"] for r in got) == 500
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pg.nodes(df).where("in_cap").count() == 2000


def test_pages_without_a_body(spark):
    assert [r["text"] for r in rows(spark, "<p>a</p>")] == ["a"]
    assert rows(spark, "") == []


def test_whole_body_is_read(spark):
    html = "<body>" + "<p>word</p>" * 20000 + "<p>a@b.co</p></body>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    text = df.select(pg.body_text("html").alias("t")).first()["t"]
    assert text.count("word") == 20000 and text.endswith("a@b.co")
    owned = detect.body_hit_owners(df).select("match", "uid").collect()
    assert [(r["match"], r["uid"]) for r in owned] == [("a@b.co", 20001)]


def test_summaries_hold_no_values(spark):
    df = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    out = detect.summaries(detect.page_rows(df))
    assert "value" not in out.columns
    assert out.where(F.col("text").contains("98765")).count() == 0


def test_signs_inside_quotes_and_names_of_attributes(spark):
    html = """<body><input placeholder="a > b" title='x < "y"' value="9876543210"><p class="nav hidden md:block" title="a hidden thing">Call 9876543211</p>
<input type=hidden value="9876543212"><p hidden>no</p><p id=x hidden="">no</p><div data-x="<p>not a tag</p>">yes</div><p>5 < 6 and 7 > 2</p></body>"""
    got = rows(spark, html)
    assert [(r["tag"], r["value"] or r["text"]) for r in got] == [
        ("input", "9876543210"), ("p", "Call 9876543211"), ("div", "yes"), ("p", "5 < 6 and 7 > 2")]
    assert (got[0]["placeholder"], got[0]["label"]) == ("a > b", 'x < "y"')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    body = df.select(pg.body_text("html").alias("t")).first()["t"]
    assert "not a tag" not in body and "5 < 6 and 7 > 2" in body


def test_long_tags_are_read_once(spark):
    import time

    for unit in ("<a ", "<a x='", "<", "<p>", "</p>", "<a \"' "):
        df = spark.createDataFrame([(1, "<body>" + unit * (300_000 // len(unit)))], "page_id long, html string")
        start = time.time()
        pg.elements(df).count()
        assert time.time() - start < 20, unit


def test_text_goes_on_through_tags_inside_a_line(spark):
    html = """<body><p>Call <b>me</b> on 9876543210 today</p><a href="/x"><i></i> Mail priya@example.com</a> <button><span>Go <em>now</em></span></button>
<label><b>Aadhaar number</b> <input name="w"></label><label for="q"><span>PAN</span> code</label><input id="q"><p>x <bold>y</bold> z</p></body>"""
    got = rows(spark, html)
    by_tag = [(r["tag"], r["text"]) for r in got if r["text"]]
    assert by_tag == [("p", "Call me on 9876543210 today"), ("b", "me"), ("a", "Mail priya@example.com"), ("button", "Go now"), ("span", "Go now"), ("em", "now"),
                      ("b", "Aadhaar number"), ("label", "PAN code"), ("span", "PAN"), ("p", "x y z"), ("bold", "y")]
    assert [r["label"] for r in got if r["tag"] == "input"] == ["Aadhaar number", "PAN code"]
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    found = {(r["category"], r["match"]) for r in detect.page_detections(df).collect()}
    assert {("phone", "9876543210"), ("email", "priya@example.com"), ("aadhaar", "Aadhaar number"), ("pan", "PAN code")} <= found


def test_whole_texts_are_scanned(spark):
    df = spark.createDataFrame([(1, "<body><p>" + "word " * 500 + "9876543210</p></body>")], "page_id long, html string")
    row = detect.page_rows(df).selectExpr("elements[0].text AS t", "detections[0].match AS m").first()
    assert len(row["t"]) == 120 and row["m"] == "9876543210"


class Tree(HTMLParser):
    """Nodes of a well-formed page: [tag, hides, parent, pieces], a piece is a text or a child's number."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.nodes, self.open = [["body", False, None, []]], [0]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        hides = any(k == "hidden" or k == "style" and ("none" in v or "visibility" in v) for k, v in attrs)
        self.nodes.append([tag, hides, self.open[-1], []])
        self.nodes[self.open[-1]][3].append(len(self.nodes) - 1)
        if tag not in pg.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if tag not in pg.VOID:
            self.open.pop()
            self.nodes[self.open[-1]][3].append(("end", tag))

    def handle_data(self, data):
        self.nodes[self.open[-1]][3].append(data)

    def hidden(self, i):
        return i is not None and i > 0 and (self.nodes[i][1] and self.nodes[i][0] not in pg.VOID or self.hidden(self.nodes[i][2]))

    def text(self, i, top=True):
        tag, _, _, pieces = self.nodes[i]
        out = "" if top or tag in pg.IN_LINE else " "
        for p in pieces:
            if isinstance(p, int):
                out += self.text(p, False)
            elif isinstance(p, tuple):
                out += "" if p[1] in pg.IN_LINE else " "
            elif not self.hidden(i):
                out += p
        return out

    def row(self, i):
        own = not self.hidden(i) and any(isinstance(p, str) and p.strip() for p in self.nodes[i][3])
        return self.nodes[i][0], " ".join(self.text(i).split()), own, self.hidden(i)


def made(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 5)):
        tag = rng.choice(["div", "p", "b", "span", "ul", "li", "section", "i", "td", "a"])
        attrs = rng.choice(["", "", "", ' class="x"', " hidden", ' style="display:none"', ' style="visibility: hidden"', ' style="color:red"', ' title="<b>"'])
        inner = made(rng, depth + 1) if depth < 4 and rng.random() < .6 else rng.choice(["", " ", "word", "two words"])
        out += rng.choice(["", " ", "x", "some text "]) + f"<{tag}{attrs}>{inner}</{tag}>" + rng.choice(["", "", "<br>", "y", " z", '<img src="a.png" hidden>'])
    return out


def test_page_tree_against_a_parser(spark):
    rng = random.Random(4)
    pages = [(i, f"<body>{made(rng)}</body>") for i in range(300)] + [(300, "<body>" + "<div>" * 300 + "deep" + "</div>" * 300 + "</body>")]
    got = {}
    for r in pg.nodes(spark.createDataFrame(pages, "page_id long, html string").repartition(8)).orderBy("page_id", "node_no").collect():
        got.setdefault(r.page_id, []).append((r.tag, " ".join(r.text.split()), r.own, r.hidden))
    for i, html in pages:
        tree = Tree(html)
        assert got[i] == [tree.row(k) for k in range(2, len(tree.nodes))], html


def test_text_behind_a_block_and_hidden_ancestors(spark):
    html = """<body><div><p>hi</p>call 9876543210 now</div><div style="display:none"><p>call 9876543211</p></div><section hidden><ul><li>9876543212</li></ul></section>
<div style="opacity:0"><p>call 9876543213</p></div><ul><li>one<li>two <b>bold</b></ul><p>a<p>b</p></body>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    by_tag = [(r["tag"], r["text"], r["has_text"]) for r in rows(spark, html)]
    assert by_tag == [("div", "hi call 9876543210 now", True), ("p", "hi", True), ("p", "call 9876543213", True),
                      ("ul", "one two bold", True), ("li", "one", True), ("li", "two bold", True), ("b", "bold", True), ("p", "a", True), ("p", "b", True)]
    assert sorted(r["match"] for r in detect.page_detections(df).collect()) == ["9876543210", "9876543213"]


def test_containers_are_scanned_in_their_parts(spark):
    """A container without text of its own shows 120 characters of its parts; each part is scanned whole."""
    html = "<body><main>" + "".join(f"<p>{'word ' * 40}98765432{i:02d}</p>" for i in range(20)) + "</main></body>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    found = [r["match"] for r in detect.page_detections(df).orderBy("uid").collect()]
    assert found == [f"98765432{i:02d}" for i in range(20)]


def test_nodes_parse_a_page_once(spark):
    rows = spark.createDataFrame([(1, "<p>a<b>c</b>"), (2, "")], "page_id long, html string")
    nodes = pg.nodes(rows)
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and plan.index("Filter") < plan.index("Generate")
    assert [(r.page_id, r.node_no, r.tag) for r in nodes.orderBy("node_no").collect()] == [(1, 1, "p"), (1, 2, "b")]


def test_large_tables_are_dealt_out_in_bounded_tasks(spark, monkeypatch, tmp_path):
    from veilspan.sources import tables

    spark.range(20000).coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert tables.spread(rows).rdd.getNumPartitions() == 8
    monkeypatch.setattr(tables, "SMALL", 0, raising=False)
    monkeypatch.setattr(tables, "TASK", 2000, raising=False)
    found = tables.spread(rows)
    assert found.rdd.getNumPartitions() > 16
    assert found.count() == 20000


def test_pages_that_pack_well_are_dealt_out_by_rows(spark, tmp_path):
    """Ten thousand equal pages are a few kilobytes of files, but as much work as any others."""
    from veilspan.sources import tables

    spark.range(10_000).selectExpr("id AS page_id", "'u' AS url", "repeat('<p>x</p>', 500) AS html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = tables.text_table(spark, str(tmp_path), "pages")
    assert rows.rdd.getNumPartitions() == 10_000 // tables.ROWS["pages"]
    assert rows.count() == 10_000
