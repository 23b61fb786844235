import json
import struct
import zipfile

from pdpspark.operators import bundle, extract, match
from pdpspark.operators.model import model_sections
from pdpspark.sources import readers, writers

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows):
    cells = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{chr(64 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in vals.items()) + "</row>"
        for r, vals in rows.items())
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>'
                                      '<sheet name="Template" r:id="r1"/><sheet name="Help" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                                                 '<Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst {NS}><si><t>shared</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c t="s"><v>1</v></c><c><v>7</v></c></row></sheetData></worksheet>')


def test_workbooks_to_rows(spark, tmp_path):
    head = {1: "et_title_product_id", 2: "et_title_product_name", 3: "Seller SKU", 4: "Parent SKU", 5: "Product Description"}
    workbook(tmp_path / "shopee.xlsx", {1: head, 2: {1: "required", 5: "text"}, 3: {1: "12345", 2: "Fridge", 3: "AB123.X", 5: "old"}, 4: {1: "note"}})
    cells = readers.read_workbooks(spark, str(tmp_path)).cache()
    hidden = {(r.row, r.col, r.text) for r in cells.where("hidden").collect()}
    assert hidden == {(1, 1, "rich"), (1, 2, "7")}
    cols = match.detect_columns(cells)
    assert {(r.role, r.col) for r in cols.collect()} == {("id", 1), ("name", 2), ("sku", 3), ("parent_sku", 4), ("desc", 5)}
    ends = match.head_end(cells, cols)
    assert ends.first().head_end == 2
    assert match.pick_sheet(cells, cols, ends).first().sheet == "Template"
    rows = match.market_rows(cells, cols, ends).collect()
    assert [(r.row, r.id, r.sku, r.desc) for r in rows] == [(3, "12345", "AB123.X", "old")]


def test_sitemap(spark, tmp_path):
    (tmp_path / "m.xml").write_text(
        '<?xml version="1.0"?><urlset><url><loc>https://www.shop.example/th/tv/oled/oled65g6/</loc><lastmod>2024-01-01</lastmod></url>'
        "<url><loc>https://www.shop.example/th/tv/oled/about/</loc></url><url><loc>https://www.shop.example/de/tv/x/qn1234.html</loc></url></urlset>")
    rows = {(r.site, r.key, r.lastmod) for r in readers.read_sitemap(spark, str(tmp_path / "m.xml"), host="shop.example$").collect()}
    assert rows == {("th", "OLED65G6", "2024-01-01"), ("de", "QN1234", "")}


def test_sitemap_index_of_indexes(spark, tmp_path):
    def index(name, *named):
        (tmp_path / name).write_text("<sitemapindex>" + "".join(f"<sitemap><loc> {tmp_path / n} </loc></sitemap>" for n in named) + "</sitemapindex>")

    index("top.xml", "b.xml", "a.xml", "b.xml", "m0.xml")
    index("a.xml", "m1.xml", "top.xml")
    index("b.xml", "m2.xml", "a.xml")
    for i in range(3):
        (tmp_path / f"m{i}.xml").write_text(f"<urlset><url><loc>https://www.shop.example/th/tv/ab{i}23?a=1&amp;b=2</loc></url></urlset>")
    names = lambda most: [p.rsplit("/", 1)[1] for p in readers.sitemap_tree(spark, str(tmp_path / "top.xml"), most)]
    assert names(30) == ["top.xml", "b.xml", "a.xml", "m0.xml", "m1.xml", "m2.xml"]
    assert names(2) == ["top.xml", "b.xml", "a.xml"] and names(4) == ["top.xml", "b.xml", "a.xml", "m0.xml", "m1.xml"]
    rows = readers.read_sitemap_tree(spark, str(tmp_path / "top.xml")).collect()
    assert sorted((r.key, r.url[-8:]) for r in rows) == [(f"AB{i}23", "?a=1&b=2") for i in range(3)]
    assert names(30) == names(30) and readers.sitemap_tree(spark, str(tmp_path / "m0.xml")) == [str(tmp_path / "m0.xml")]


def test_mirrors_and_sidecars(spark, tmp_path):
    for name, ok in (("www-a", True), ("www-b", False), ("_trash", True)):
        d = tmp_path / "out" / name
        d.mkdir(parents=True)
        (d / "mirror.json").write_text(json.dumps({"product_title": "T", "sections": [
            {"order": 1, "text": "x", "component_dom_index": 3, "media": [{"pc_url": "u"}]}, {"order": "1 - disclaimer", "text": "", "component_dom_index": -1}]}))
        if ok:
            (d / "source.json").write_text(json.dumps({"url": "https://x.example/th/a/", "crawled_at": 1700000000.5}))
    mirrors = readers.read_mirrors(spark, str(tmp_path / "out"))
    assert [(r.slug, r.country) for r in mirrors.collect()] == [("www-a", "th")]
    secs, media = readers.explode_sections(mirrors)
    got = [(r.sec_ord, r.order_n, r.kind, r.dom_index, r.text) for r in secs.orderBy("sec_ord").collect()]
    assert got == [(0, 1, "content", 3, "x"), (1, 1, "disclaimer", None, None)] and media.count() == 1
    side = tmp_path / "side"
    side.mkdir()
    (side / "p1.fc.md").write_text("# Title\nline")
    (side / "p1.fc.meta.json").write_text('{"title": "One", "og:image": ["a", "b"]}')
    (side / "p1.geo.json").write_text('[{"src": "s", "rw": 10, "rt": 5, "rl": 0}]')
    md, meta, geo = readers.read_sidecars(spark, str(side))
    assert md.first().md == "# Title\nline" and geo.first().rw == 10
    row = meta.select(readers.meta_value("meta", "title").alias("t"), readers.meta_value("meta", "og:image").alias("i")).first()
    assert (row.t, row.i) == ("One", "a")


def test_page_model(spark):
    model = '{"x": {"overview-section": {":itemsOrder": ["b", "a"], ":items": {"a": {":type": "t/text", "text": "<p>Hi</p>"}, "b": {":type": "t/image", "imageRef": "/i.jpg", "title": "Big"}}}}}'
    halves = model[:40], model[40:]
    html = "".join(f"<script>self.__next_f.push([1,{json.dumps(h)}])</script>" for h in halves)
    pages = spark.createDataFrame([(1, html), (2, "none")], "page_id long, html string")
    rows = model_sections(readers.page_model(pages), "https://x.example", root="/").orderBy("order").collect()
    assert [(r.component_id, r.text, [m.pc_url for m in r.media]) for r in rows] == [
        ("AEM:image", "## Big", ["https://x.example/i.jpg"]), ("AEM:text", "Hi", [])]


def test_image_headers(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + struct.pack(">II", 640, 480) + b"\0" * 20
    gif = b"GIF89a" + struct.pack("<HH", 12, 7) + b"\0" * 30
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 90, 160) + b"\0" * 20
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little") + b"\0" * 8
    for name, data in (("a.png", png), ("b.gif", gif), ("c.jpg", jpg), ("d.webp", webp)):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: (r.width, r.height) for r in readers.image_dims(readers.read_images(spark, str(tmp_path))).collect()}
    assert rows == {"a.png": (640, 480), "b.gif": (12, 7), "c.jpg": (160, 90), "d.webp": (800, 600)}


def test_component_specs_and_writers(spark, tmp_path):
    for folder, name in (("one", "First"), ("two", "Second")):
        d = tmp_path / folder
        d.mkdir()
        (d / "ST0001 Hero.md").write_text(f"# {name}\n36/42 #ffffff 16/24 #FFFFFF overlay")
        (d / "README.md").write_text("# no")
    rows = readers.read_component_specs(spark, [str(tmp_path / "one"), str(tmp_path / "two")]).collect()
    assert [(r.component_id, r.name, r.fonts, r.colors) for r in rows] == [("ST0001", "First", ["16/24", "36/42"], ["#FFFFFF"])]
    df = spark.createDataFrame([("th", 1), ("de", 2)], "country string, n int")
    writers.write_products({"p": df}, str(tmp_path / "t"))
    writers.write_products({"p": spark.createDataFrame([("th", 9)], "country string, n int")}, str(tmp_path / "t"))
    assert {(r.country, r.n) for r in spark.read.parquet(str(tmp_path / "t" / "p")).collect()} == {("th", 9), ("de", 2)}


def test_json_ld_and_bundle(spark):
    html = ('<script type="application/ld+json">{"@type":"Crumb"}</script><script type="application/ld+json">[{"@type":"Product","name":"Set","sku":"S1"}]</script>'
            '<div id="pdp-overview-section"><a href="/th/laundry/w1/">w</a><a href="/support/x">s</a><a href="/th/laundry/d2/?a=1">d</a></div>'
            '<div id="pdp-specs-section"><div id="pto-tabs-1" role="tab">Washer | F4WR709G</div><div id="pto-tabs-2" role="tab">Dryer | RT80V9W</div></div>')
    pages = spark.createDataFrame([(1, "https://x.example/th/bundles/s1/", html)], "page_id long, url string, html string")
    assert [(r.name, r.sku) for r in extract.ld_products(pages).collect()] == [("Set", "S1")]
    flags, links, slides = bundle.bundle_candidates(pages)
    assert flags.first().is_bundle is True
    sitemap = spark.createDataFrame([("rt80v9w", "https://x.example/th/laundry/rt80v9w/")], "key string, url string")
    rows = bundle.bundle_urls(links, slides, sitemap).orderBy("index").collect()
    assert [(r.model, r.url.rsplit("/", 2)[1], r.found_by) for r in rows] == [("F4WR709G", "w1", "overview_link"), ("RT80V9W", "d2", "overview_link")]
