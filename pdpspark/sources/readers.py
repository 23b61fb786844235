"""Readers for every input of the hub: pages, product documents, sidecars, sitemaps, workbooks, page models, rule files."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.match import sitemap_index
from ..operators.ordered import drop_repeats, first_rows

SECTION_SCHEMA = (
    "product_title string, _gen int, "
    "sections array<struct<`order`:string,text:string,component_id:string,component_dom_index:int,layout_type:string,column_count:int,"
    "text_alignment:string,item_group:boolean,group_heading:string,disclaimers:array<string>,"
    "text_roles:array<struct<role:string,text:string>>,"
    "media:array<struct<pc_url:string,mobile_url:string,unified_url:string,type:string,role:string,recovered:boolean>>,"
    "specs:array<struct<label:string,value:string,`group`:string,section:string>>>>, "
    "_gallery array<struct<pc_url:string,mobile_url:string,unified_url:string,type:string,role:string>>"
)
SOURCE_SCHEMA = "url string, crawled_at double"
GEOMETRY_SCHEMA = "src string, rw int, rt int, rl int"
CELL_SCHEMA = "upload_id string, sheet string, hidden boolean, row int, col int, text string"
FILE_NAME = r"([^/]+)$"


def read_pages(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """Crawled pages (S1); without html only the narrow columns are read."""
    pages = spark.read.parquet(path)
    return pages if with_html else pages.drop("html", "md")


def _decoded(name: Column) -> Column:
    """A URL-encoded name decoded; a name that isn't one stays as it is."""
    return F.coalesce(F.try_url_decode(name), name)


def _slug_of(file: str, depth: int = 2) -> Column:
    return _decoded(F.element_at(F.split(F.col(file), "/"), -depth))


def read_mirrors(spark: SparkSession, root: str) -> DataFrame:
    """Product documents (S2): one mirror.json and one source.json per directory, both required, `_` directories skipped."""
    def one(name: str, schema: str) -> DataFrame:
        rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option(
            "pathGlobFilter", name).json(root)
        return rows.select("*", F.col("_metadata.file_path").alias("__f")).withColumn("slug", _slug_of("__f")).drop("__f").where(
            ~F.startswith("slug", F.lit("_")))

    source = one("source.json", SOURCE_SCHEMA).where("url is not null").withColumn("crawled_at", F.timestamp_micros((F.col("crawled_at") * 1e6).cast("bigint")))
    return one("mirror.json", SECTION_SCHEMA).join(source, "slug").withColumn("country", urls.country_of("url"))


def explode_sections(mirrors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, section media) child tables with ordinals; the mixed `order` value becomes a number and a kind."""
    flat = mirrors.select("slug", F.posexplode("sections").alias("sec_ord", "s")).select("slug", "sec_ord", "s.*")
    flat = flat.withColumns({
        "order_n": F.regexp_extract(F.coalesce("order", F.lit("")), r"^(\d+)", 1).try_cast("int"),
        "kind": F.when(F.contains(F.coalesce("order", F.lit("")), F.lit("disclaimer")), "disclaimer").when(
            F.startswith(F.coalesce("order", F.lit("")), F.lit("gallery")), "gallery").otherwise("content"),
        "dom_index": F.when(F.col("component_dom_index") >= 0, F.col("component_dom_index")), "text": F.nullif("text", F.lit("")),
    })
    media = flat.select("slug", "sec_ord", F.posexplode("media").alias("media_ord", "m")).select("slug", "sec_ord", "media_ord", "m.*")
    return flat.drop("media", "order", "component_dom_index"), media


def read_sidecars(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(markdown, meta, geometry) next to the pages (S3): meta as VARIANT, values being strings or arrays."""
    def whole(suffix: str) -> DataFrame:
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True).select(
            F.regexp_replace(_decoded(F.element_at(F.split("_metadata.file_path", "/"), -1)), re.escape(suffix) + "$", "").alias("slug"), "value")

    md = whole(".fc.md").withColumnRenamed("value", "md")
    meta = whole(".fc.meta.json").select("slug", F.try_parse_json("value").alias("meta"))
    geo = whole(".geo.json").select("slug", F.explode(F.from_json("value", f"array<struct<{GEOMETRY_SCHEMA.replace(' ', ':').replace(',:', ',')}>>")).alias("g"))
    return md, meta, geo.select("slug", "g.*")


def meta_value(meta: Column | str, name: str) -> Column:
    """One meta entry as text, the first element when it is an array."""
    path = f"$['{name}']"
    return F.coalesce(F.try_variant_get(meta, f"{path}[0]", "string"), F.try_variant_get(meta, path, "string"))


def read_sitemap(spark: SparkSession, path: str | list[str], site: str | None = None, host: str | None = None) -> DataFrame:
    """Sitemap entries with model keys."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return sitemap_index(rows.select(F.trim("loc").alias("url"), "lastmod"), site, host)


def sitemap_children(spark: SparkSession, path: str) -> DataFrame:
    """Addresses of the sub-maps a sitemap index names."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("url"))


SUB_MAPS = 30


def sitemap_tree(spark: SparkSession, path: str, most: int = SUB_MAPS) -> list[str]:
    """A sitemap and the sub-maps below it, indexes of indexes included: each once, level by level, at most `most` sub-maps.

    One read a level: its files are the frontier, and what they name and no earlier level held is the next one. Files of a level count in the
    order of their addresses, the entries of a file in their own; no more than `most` entries a file reach the driver.
    """
    found, frontier = [path], [path]
    while frontier and len(found) <= most:
        entries = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(frontier).select(
            F.trim("loc").alias("url"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"))
        named = first_rows(entries.where(F.length("url") > 0), ["file"], [F.col("place")], n=most, rank="nth")
        ordered = [r.url for r in named.orderBy("file", "nth").select("url").collect()]
        frontier = [u for u in dict.fromkeys(ordered) if u not in found][: most + 1 - len(found)]
        found += frontier
    return found


def read_sitemap_tree(spark: SparkSession, path: str, site: str | None = None, host: str | None = None, most: int = SUB_MAPS) -> DataFrame:
    """Entries with model keys of a sitemap and of all sub-maps that its index names."""
    return read_sitemap(spark, sitemap_tree(spark, path, most), site, host)


# ---------------------------------------------------------------- workbooks

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_CELLS = pa.schema([
    ("upload_id", pa.string()), ("sheet", pa.string()), ("hidden", pa.bool_()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()),
])


def _said(node) -> str:
    """Text of a string item, phonetic runs left out."""
    parts = []
    for child in node:
        if child.tag == _NS + "t":
            parts.append(child.text or "")
        elif child.tag == _NS + "r":
            parts.extend(t.text or "" for t in child.findall(_NS + "t"))
    return "".join(parts)


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n


def _workbook_cells(upload: str, content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = [_said(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(_NS + "si")]
        links = {
            r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        }
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_NS + "sheet"):
            target = links.get(sheet.get(_REL), "").lstrip("/")
            path = target if target.startswith("xl/") else "xl/" + target
            if path not in names:
                continue
            hidden = sheet.get("state") in ("hidden", "veryHidden")
            row_no = 0
            for row in ElementTree.fromstring(book.read(path)).iter(_NS + "row"):
                row_no = int(row.get("r") or row_no + 1)
                col_no = 0
                for cell in row.findall(_NS + "c"):
                    col_no = _column(cell.get("r")) if cell.get("r") else col_no + 1
                    kind, value = cell.get("t"), cell.find(_NS + "v")
                    if kind == "inlineStr":
                        inline = cell.find(_NS + "is")
                        said = _said(inline) if inline is not None else ""
                    elif value is None or value.text is None:
                        continue
                    else:
                        said = shared[int(value.text)] if kind == "s" else value.text
                    yield upload, sheet.get("name"), hidden, row_no, col_no, said


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks to a long cell table (S5); many files in parallel, one archive per row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = list(_workbook_cells(name, content))
                if cells:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells), _CELLS)], schema=_CELLS)

    named = files.select(_decoded(F.regexp_extract("path", FILE_NAME, 1)).alias("upload_id"), "content")
    return named.mapInArrow(decode, CELL_SCHEMA)


# ---------------------------------------------------------------- embedded page models

_PUSH = r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)'
_MODEL = pa.schema([("page_id", pa.int64()), ("model", pa.string())])


def _with_order(node: dict) -> dict:
    """Children keep the order of the page where a node lists none: VARIANT sorts its keys."""
    items = node.get(":items")
    return node if not isinstance(items, dict) or node.get(":itemsOrder") else {**node, ":itemsOrder": list(items)}


def _model_of(pushes: list[str]) -> str | None:
    """The overview part of a page model as JSON text."""
    text = "".join(json.loads(p) for p in pushes)
    at = text.find('"overview-section":')
    if at < 0:
        return None
    rest = text[at + len('"overview-section":'):].lstrip()
    try:
        value, _ = json.JSONDecoder(object_hook=_with_order).raw_decode(rest)
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False)


def page_model(pages: DataFrame) -> DataFrame:
    """(page_id, model VARIANT): the embedded overview model of each page."""
    pushes = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.regexp_extract_all("html", F.lit(_PUSH), 1).alias("pushes")).where(
        F.size("pushes") > 0)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = [_model_of(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(models, pa.string())], schema=_MODEL)

    return pushes.mapInArrow(decode, "page_id bigint, model string").where("model is not null").select(
        "page_id", F.parse_json("model").alias("model"))


# ---------------------------------------------------------------- dimensions


def read_component_specs(spark: SparkSession, dirs: list[str]) -> DataFrame:
    """(component_id, name, fonts, colors): design specs of components, the first directory that has one wins."""
    rows = None
    for rank, folder in enumerate(dirs):
        one = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(
            F.lit(rank).alias("rank"), _decoded(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file"), "value")
        rows = one if rows is None else rows.unionByName(one)
    head = F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1)
    cid = F.regexp_extract("file", r"((?:ST|PD|CM|PR|PN|GN|AL)\d{4})", 1)
    fonts = F.array_sort(F.array_distinct(F.regexp_extract_all("value", F.lit(r"\b(\d{2}/\d{2})\b"), 1)))
    colours = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("value", F.lit(r"(#[0-9A-Fa-f]{6})\b"), 1), lambda c: F.upper(c))))
    specs = rows.where(~F.col("file").rlike(r"(?i)^readme|-ELEMENTS")).select(
        "rank", "file", cid.alias("component_id"), head.alias("name"), F.col("value").rlike("(?i)overlay").alias("is_overlay"), fonts.alias("fonts"),
        colours.alias("colors")).where("component_id <> ''")
    return drop_repeats(specs, ["component_id"], ["rank", "file"]).drop("rank", "file")


def load_medium(spark: SparkSession, path: str) -> DataFrame:
    """Rule file of a channel as one row."""
    return spark.read.option("multiLine", True).json(path)


def _jpeg_size(content: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        mark = content[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7:at + 9], "big"), int.from_bytes(content[at + 5:at + 7], "big")
        if mark == 0xFF or 0xD0 <= mark <= 0xD9:
            at += 1 if mark == 0xFF else 2
            continue
        at += 2 + int.from_bytes(content[at + 2:at + 4], "big")
    return None


def _jpeg_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [_jpeg_size(c) or (None, None) for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(["jpeg"] * len(sizes)), pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())],
            names=["path", "format", "width", "height"])


def image_dims(files: DataFrame) -> DataFrame:
    """(path, format, width, height) from the first bytes of PNG, GIF, WebP and JPEG files (S10). files: path, content."""
    hexed = lambda start, n: F.hex(F.substring("content", start, n))
    num = lambda h: F.conv(h, 16, 10).cast("int")
    swap = lambda h, n: F.concat(*[F.substring(h, 2 * i - 1, 2) for i in range(n, 0, -1)])
    magic = hexed(1, 4)
    kind = (
        F.when(magic == "89504E47", "png").when(F.startswith(magic, F.lit("474946")), "gif")
        .when((magic == "52494646") & (hexed(9, 4) == "57454250"), "webp").when(F.startswith(magic, F.lit("FFD8")), "jpeg")
    )
    box = hexed(13, 4)
    lossy_w, lossy_h = num(swap(hexed(27, 2), 2)).bitwiseAND(0x3FFF), num(swap(hexed(29, 2), 2)).bitwiseAND(0x3FFF)
    wide_w, wide_h = num(swap(hexed(25, 3), 3)) + 1, num(swap(hexed(28, 3), 3)) + 1
    bits = F.conv(swap(hexed(22, 4), 4), 16, 10).cast("bigint")
    less_w, less_h = bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1
    rows = files.withColumn("format", kind)
    plain = rows.where("format <> 'jpeg'").select("path", "format", F.when(F.col("format") == "png", num(hexed(17, 4))).when(
        F.col("format") == "gif", num(swap(hexed(7, 2), 2))).when(box == "56503820", lossy_w).when(box == "56503858", wide_w).otherwise(less_w).cast("int").alias("width"),
        F.when(F.col("format") == "png", num(hexed(21, 4))).when(F.col("format") == "gif", num(swap(hexed(9, 2), 2))).when(
            box == "56503820", lossy_h).when(box == "56503858", wide_h).otherwise(less_h).cast("int").alias("height"))
    jpeg = rows.where("format = 'jpeg'").select("path", "content").mapInArrow(_jpeg_batches, "path string, format string, width int, height int")
    return plain.unionByName(jpeg)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files for image_dims."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

