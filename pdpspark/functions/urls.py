"""URL, key and identifier columns. Every function maps Column (or column name) to Column; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File-name and path marks that decide how two addresses count as the same asset.
SIZE_MARK = r"[._-]\d{2,4}x\d{2,4}"
IMAGE_EXT = "jpg|jpeg|png|webp|gif"
VIDEO_EXT = "mp4|webm|mov"
SITE_CODE = r"^[a-z]{2}(_[a-z]{2})?$"
URL_SAFE = r"A-Za-z0-9_.\-~:/?#\[\]@!$&'()*+,;=%"
REPEATED_DAM = r"(?:/content/dam/channel/wcms){2,}"
DAM_ROOT = "/content/dam/channel/wcms"


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _drop(value: Column, pattern: str) -> Column:
    return F.regexp_replace(value, pattern, "")


def _text(value: Column | str) -> Column:
    return F.coalesce(_c(value), F.lit(""))


def js_or(*values: Column | str) -> Column:
    """First value that is neither NULL nor the empty string."""
    return F.coalesce(*[F.nullif(_c(v), F.lit("")) for v in values])


def slugify(url: Column | str, ascii: bool = False) -> Column:
    word = "A-Za-z0-9_" if ascii else r"\p{L}\p{N}_"
    bare = F.regexp_replace(F.trim(_c(url)), r"(?s)^(.*?)https?://", "$1")
    return _drop(F.regexp_replace(bare, f"[^{word}]+", "-"), "-+$")


def category_key(name: Column | str) -> Column:
    dashed = F.regexp_replace(F.lower(F.trim(_text(name))), r"[^\p{L}\p{N}]+", "-")
    return js_or(_drop(dashed, "^-|-$"), F.lit("general"))


def country_of(url: Column | str, host: str = r"[^/\s]+") -> Column:
    """Two-letter country from the first path segment; `host` is a regex for the brand's host names."""
    return F.lower(F.regexp_extract(_text(url), rf"(?i)//{host}/([a-z]{{2}})(?:_[a-z]{{2}})?/", 1))


def host_of(url: Column | str) -> Column:
    return F.try_parse_url(_c(url), F.lit("HOST"))


def path_of(url: Column | str) -> Column:
    return F.try_parse_url(_c(url), F.lit("PATH"))


def path_segments(url: Column | str) -> Column:
    """Non-empty path parts; NULL when the address does not parse."""
    return F.filter(F.split(path_of(url), "/"), lambda part: part != "")


def site_of(url: Column | str) -> Column:
    return F.try_element_at(path_segments(url), F.lit(1))


def last_segment(url: Column | str) -> Column:
    return _drop(F.coalesce(F.try_element_at(path_segments(url), F.lit(-1)), F.lit("")), r"(?i)\.html?$")


def model_of(url: Column | str) -> Column:
    return F.upper(last_segment(url))


def norm_key(value: Column | str) -> Column:
    return _drop(F.upper(_text(value)), "[^A-Z0-9]")


def sku_parts(sku: Column | str) -> Column:
    """The bundle parts of one SKU cell."""
    return F.split(_text(sku), r"(?i)\s*[+&,|/]\s*|\s+and\s+")


def part_keys(part: Column) -> Column:
    """Both keys of a bundle part in capitals: head before the suffix, then the whole."""
    return F.array(norm_key(F.element_at(F.split(part, r"[.\s_]"), 1)), norm_key(part))


def sku_keys(sku: Column | str) -> Column:
    """Model-key candidates of one SKU cell: head before the suffix, then the whole part, for every bundle part."""
    parts = F.filter(F.transform(sku_parts(sku), lambda p: F.upper(F.trim(p))), lambda p: p != "")
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, part_keys)), lambda k: F.length(k) >= 4))


def name_tokens(name: Column | str) -> Column:
    """The words of a product name that may be model codes."""
    return F.split(F.upper(_text(name)), r"[^A-Z0-9.\-]+")


def token_keys(token: Column) -> Column:
    """Both keys of such a word: head before the suffix, then the whole."""
    return F.array(norm_key(F.element_at(F.split(token, r"\."), 1)), norm_key(token))


def name_keys(name: Column | str, min_len: int = 5) -> Column:
    """Model-key candidates inside a free-text product name."""
    keys = F.flatten(F.transform(name_tokens(name), token_keys))
    return F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_len))


def is_bundle(*skus: Column | str) -> Column:
    return F.concat_ws(" ", *[_c(s) for s in skus]).rlike("[+&]")


def title_case(value: Column | str) -> Column:
    spaced = F.regexp_replace(_text(value), "[-_]+", " ")
    return F.array_join(
        F.transform(
            F.split(spaced, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
        ),
        "",
    )


def abs_url(url: Column | str, origin: Column | str, upgrade: bool = True, drop_data: bool = False) -> Column:
    u = F.trim(_text(url))
    base = F.lit(origin) if isinstance(origin, str) else origin
    out = F.when(u == "", "")
    if drop_data:
        out = out.when(u.startswith("data:"), "")
    out = out.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(base, u))
    if upgrade:
        out = out.when(u.startswith("http://"), F.concat(F.lit("https://"), F.substring(u, 8, 1 << 30)))
    return out.otherwise(u)


def clean_url(url: Column | str) -> Column:
    """Percent-encode what a URL must not carry; reserved marks and existing escapes stay."""
    unsafe = F.regexp_extract_all(F.trim(_c(url)), F.lit(f"[^{URL_SAFE}]+|[{URL_SAFE}]+"), 0)
    return F.array_join(
        F.transform(
            unsafe,
            lambda p: F.when(p.rlike(f"^[{URL_SAFE}]"), p).otherwise(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))),
        ),
        "",
    )


def srcset_head(srcset: Column | str, srcset_fix: bool = True) -> Column:
    return F.trim(F.element_at(F.split(F.trim(_text(srcset)), r",\s+" if srcset_fix else ","), 1))


def srcset_first(srcset: Column | str, srcset_fix: bool = True) -> Column:
    """Address of the first candidate, width/density mark removed."""
    return clean_url(_drop(srcset_head(srcset, srcset_fix), r"\s+\d+(\.\d+)?[wx]$"))


def srcset_best(srcset: Column | str) -> Column:
    """Address with the best descriptor: Nw counts N, Nx counts N*1000, none counts 500; first wins on ties."""
    parts = F.transform(
        F.split(_text(srcset), ","),
        lambda p, i: F.struct(
            F.element_at(F.split(F.trim(p), r"\s+"), 1).alias("u"),
            F.coalesce(F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)), F.lit("")).alias("d"),
            i.alias("i"),
        ),
    )
    scored = F.transform(
        F.filter(parts, lambda p: p["u"] != ""),
        lambda p: F.struct(
            F.when(p["d"].rlike(r"(?i)^\d+w$"), F.regexp_extract(p["d"], r"^(\d+)", 1).cast("double"))
            .when(p["d"].rlike(r"(?i)^[\d.]+x$"), F.regexp_extract(p["d"], r"^([\d.]+)", 1).try_cast("double") * 1000)
            .otherwise(F.lit(500.0))
            .alias("score"),
            (-p["i"]).alias("rank"),
            p["u"].alias("u"),
        ),
    )
    return F.coalesce(F.array_max(scored)["u"], F.lit(""))


def bare_url(url: Column | str) -> Column:
    """Address without query and fragment."""
    return _drop(_text(url), r"(?s)[?#].*$")


def _no_query(url: Column | str) -> Column:
    return F.element_at(F.split(_text(url), r"\?"), 1)


def file_name(url: Column | str) -> Column:
    return F.element_at(F.split(_no_query(url), "/"), -1)


def image_key(url: Column | str, decode: bool = False) -> Column:
    name = F.replace(F.lower(_drop(_drop(_no_query(url), r"/jcr:content/.*$"), r"^.*/")), F.lit("%20"), F.lit(" "))
    if decode:
        name = F.coalesce(F.try_url_decode(name), name)
    return _drop(name, SIZE_MARK)


def dedup_stem(url: Column | str) -> Column:
    folded = F.regexp_replace(bare_url(url), "(?i)/(desktop|mobile|pc)/", "/")
    name = _drop(folded, r"^.*/")
    name = F.regexp_replace(name, r"(?i)[-_](m|d|gb-d|gb-m|gb|mobile|desktop|mo|pc)(\.\w+)$", "$2")
    return F.lower(_drop(_drop(name, "(?i)[-_](desktop|mobile)"), r"\d{2,4}x\d{2,4}"))


def asset_key(url: Column | str) -> Column:
    name = F.lower(F.regexp_extract(_text(url), rf"(?i)/([^/]+\.(?:{IMAGE_EXT}))", 1))
    return F.when(name == "", _text(url)).otherwise(F.regexp_replace(name, SIZE_MARK + r"(\.[^.]*)$", "$1"))


def dam_path_key(url: Column | str) -> Column:
    return F.lower(_drop(_drop(_no_query(url), "^https?://[^/]+"), r"(?s)/jcr:content.*$"))


def effective_width(url: Column | str) -> Column:
    """Rendered width an address promises: w= query, else widest WxH mark, else full size."""
    u = _text(url)
    query = F.regexp_extract(u, r"[?&]w=(\d+)", 1)
    widths = F.transform(F.regexp_extract_all(u, F.lit(r"(\d{2,4})x(\d{2,4})"), 1), lambda w: w.cast("int"))
    return (
        F.when(u == "", 0)
        .when(query != "", query.try_cast("int"))
        .otherwise(F.coalesce(F.array_max(widths), F.lit(100000)))
    )


def file_stem(url: Column | str) -> Column:
    name = _drop(_drop(_drop(bare_url(url), "^.*/"), r"\.\w+$"), "(?i)-(m|d|gb|gb-d|gb-m)$")
    return _drop(name, "(?i)-(m|d)$")


def variant_stem(url: Column | str) -> Column:
    return F.regexp_replace(bare_url(url), r"(?i)-(m|d)(\.\w+)$", "$2")


def dam_folder(url: Column | str) -> Column:
    return F.regexp_extract(_text(url), "(/content/dam/[^?#]*/)", 1)


def fold_name(url: Column | str) -> Column:
    name = _drop(F.lower(_drop(_text(url), "^.*/")), rf"\.(jpe?g|png|webp|gif|{VIDEO_EXT})$")
    name = _drop(name, r"\(thumbnail\)")
    return _drop(name, r"([-_ ](desktop|mobile|tablet|pc|mo|d|m|t|v\d+|\d{3,4}(x\d{3,4})?))+$")


def to_desktop(url: Column | str) -> Column:
    """-m name becomes -d, mobile folder becomes desktop."""
    return F.regexp_replace(F.regexp_replace(_text(url), r"-m(\.\w+)$", "-d$1"), "(?i)/mobile/", "/desktop/")


def to_mobile(url: Column | str) -> Column:
    return F.regexp_replace(_text(url), r"(?i)-d(\.\w+)$", "-m$1")


def guess_desktop(url: Column | str) -> Column:
    u = F.regexp_replace(_text(url), r"(?i)([-_])M(\.(?:jpe?g|png|webp|gif)(?:\?|$))", "$1D$2")
    u = F.regexp_replace(u, "(?i)([-_])mobile([-_./])", "$1desktop$2")
    u = F.regexp_replace(u, "(?i)/mobile/", "/desktop/")
    return F.regexp_replace(u, r"(?i)([-_])sp(\.(?:jpe?g|png|webp)(?:\?|$))", "$1pc$2")


def variants_of(url: Column | str) -> Column:
    base = bare_url(url)
    return F.array_distinct(F.array(base, F.regexp_replace(base, r"(?i)-m(\.\w+)$", "-d$1"), to_mobile(base)))


def is_mobile_url(url: Column | str, names_only: bool = False) -> Column:
    pattern = (
        r"(?i)[-_]m\.(jpe?g|png|webp|gif)(\?|$)|[-_]mobile[-_./]|/mobile/|[-_]sp\.(jpe?g|png|webp)(\?|$)"
        if names_only
        else r"(?i)-m(\.\w+)$|/mobile/|_mobile|318x300"
    )
    return _text(url).rlike(pattern)


def is_video_url(url: Column | str) -> Column:
    return _text(url).rlike(rf"(?i)\.({VIDEO_EXT})(\?|$)")


def media_range(query: Column | str) -> Column:
    q = _text(query)
    return F.struct(
        F.regexp_extract(q, r"min-width:\s*(\d+)", 1).try_cast("int").alias("lo"),
        F.regexp_extract(q, r"max-width:\s*(\d+)", 1).try_cast("int").alias("hi"),
    )


def device_of(query: Column | str) -> Column:
    q = F.lower(_text(query))
    lo = F.regexp_extract(q, r"min-width\s*:\s*(\d+)px", 1).try_cast("int")
    hi = F.regexp_extract(q, r"max-width\s*:\s*(\d+)px", 1).try_cast("int")
    return F.when(lo >= 600, "desktop").when(lo.isNull() & (hi <= 1024), "mobile").otherwise("neutral")


def best_url(pc: Column | str, mobile: Column | str, unified: Column | str, prefer: str = "pc") -> Column:
    """`pc`: pc, unified, mobile. `mobile`: mobile, pc, unified."""
    order = (pc, unified, mobile) if prefer == "pc" else (mobile, pc, unified)
    return F.coalesce(js_or(*order), F.lit(""))


def fix_dup_dam(url: Column | str) -> Column:
    return F.regexp_replace(_text(url), REPEATED_DAM, DAM_ROOT)


def origin_from_slug(slug: Column | str, pattern: str, default: str) -> Column:
    """Host part of a slug (regex group 1, dashes for dots) as an https origin."""
    host = F.regexp_extract(_text(slug), pattern, 1)
    return F.when(host == "", default).otherwise(F.concat(F.lit("https://"), F.replace(host, F.lit("-"), F.lit("."))))


def col_number(letters: Column | str) -> Column:
    chars = F.filter(F.split(F.upper(_text(letters)), ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(0), lambda acc, ch: acc * 26 + F.ascii(ch) - 64)


def col_letters(number: Column | str) -> Column:
    """Spreadsheet column name; three letters cover every sheet."""
    n = _c(number).cast("int")
    digit = lambda v: F.char(F.lit(65) + v)
    two, three = F.floor((n - 1) / 26), F.floor((n - 27) / 676)
    return F.concat(
        F.when(n > 702, digit((three - 1) % 26)).otherwise(F.lit("")),
        F.when(n > 26, digit((two - 1) % 26)).otherwise(F.lit("")),
        digit((n - 1) % 26),
    )


def crop_url(url: Column | str, crop: Column | str, path: str = "/api/v1/image-crop") -> Column:
    """Address that serves a cut of an image; the whole image keeps its own address."""
    c = _c(crop)
    box = F.format_string("%.4f,%.4f,%.4f,%.4f", *[F.bround(c[k], 4) for k in ("x", "y", "w", "h")])
    quoted = F.replace(F.url_encode(_c(url)), F.lit("+"), F.lit("%20"))
    return F.when(c.isNull() | (c["kind"] == "full"), _c(url)).otherwise(
        F.concat(F.lit(path + "?url="), quoted, F.lit("&box="), box)
    )


def youtube_id(src: Column | str) -> Column:
    s = _text(src)
    ids = [
        F.regexp_extract(s, p + "([a-zA-Z0-9_-]+)", 1)
        for p in (r"youtube\.com/embed/", r"youtube\.com/watch\?v=", r"youtu\.be/")
    ]
    return js_or(*ids)


def css_unescape(value: Column | str) -> Column:
    """CSS hex escapes (\\2f for a slash) back to characters."""
    parts = F.regexp_extract_all(_text(value), F.lit(r"\\[0-9a-fA-F]{2,6}\s?|[^\\]+|\\"), 0)
    hexed = r"^\\([0-9a-fA-F]{2,6})\s?$"
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                p.rlike(hexed),
                F.decode(
                    F.unhex(F.lpad(F.regexp_extract(p, hexed, 1), 8, "0")), "UTF-32"
                ),
            ).otherwise(p),
        ),
        "",
    )


def xml_escape(value: Column | str) -> Column:
    out = _text(value)
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(mark))
    return out


def safe_filename(name: Column | str, default: str = "bulk.xlsx") -> Column:
    return js_or(
        F.left(F.regexp_replace(js_or(name, F.lit(default)), r'[\x00-\x1f\\/:*?"<>|]+', "_"), F.lit(150)), F.lit(default)
    )


def page_path(url: Column | str, root: str) -> Column:
    """Repository path of a product page: root/cc/cc/rest/ in lower case."""
    segs = path_segments(url)
    cc = F.try_element_at(segs, F.lit(1))
    rest = F.lower(F.array_join(F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1))), "/"))
    return F.when(F.size(segs) == 0, "").otherwise(F.concat(F.lit(root), F.lit("/"), cc, F.lit("/"), cc, F.lit("/"), rest, F.lit("/")))


def url_hash20(url: Column | str) -> Column:
    return F.left(F.sha1(F.lower(_drop(F.trim(_text(url)), "/+$"))), F.lit(20))


def valid_product_url(url: Column | str, country: Column | str | None = None, host: str | None = None) -> Column:
    u, segs = _c(url), path_segments(url)
    site = F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit(""))
    ok = (F.try_parse_url(u, F.lit("PROTOCOL")) == "https") & host_of(u).isNotNull() & (F.size(segs) >= 3)
    ok = ok & site.rlike(SITE_CODE)
    if host is not None:
        ok = ok & host_of(u).rlike(host)
    if country is not None:
        cc = _c(country)
        ok = ok & (cc.isNull() | (cc == "") | (F.substring(site, 1, 2) == cc))
    return F.coalesce(ok, F.lit(False))
