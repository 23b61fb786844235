"""Rule ladders: classification, component buckets, media predicates, page checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_ws
from .urls import (
    SITE_CODE, _c, _drop, _no_query, _text, file_name, last_segment, path_of, path_segments, title_case,
)

# Ordered rules, first match wins.
CATEGORY_RULES = [
    ("TV", r"tvs?[-_/]|oled|qned|stanbyme|lifestyle-(tvs|screens|ekranlar)"),
    ("Audio", "soundbar|speaker|lautsprecher|audio"),
    ("Fridge", "fridge|refrigerator|kuehl"),
    ("Dishwasher", "dishwasher"),
    ("Washer", "wash|laundry|dryer|waesche"),
    ("Monitor", "monitor"),
    ("Laptop", "laptop|gram"),
    ("Cooking", "microwave|cook|oven"),
    ("Air", "air|puricare|dehumid|condicionado"),
]
DIVISION_RULES = [
    ("ES", r"(^|[^a-z])(aircon|air[-_ ]?condition\w*|air[-_ ]?purif\w*|puricare|dehumid\w*|air[-_ ]?solution\w*|air[-_ ]?care"
           r"|klima\w*|luftreiniger|luftentfeuchter|condicionado|purificador)([^a-z]|$)"),
    ("MS", r"(^|[^a-z])(tvs?|oled|qned|nanocell|stanbyme|lifestyle[-_ ]?(tvs|screens|ekranlar)|audio|soundbars?"
           r"|sound[-_ ]?suite|speakers?|lautsprecher|xboom|xboombuds|earbuds|kopfhoerer|headphones?|tone[-_ ]?free|monitors?"
           r"|monitore|laptops?|gram|notebooks?|it[-_ ]?products?|projectors?|beamer|cinebeam)([^a-z]|$)"),
]
GROUP_RULES = {
    "ES": [
        ("Dehumidifier", "dehumid|entfeuchter"),
        ("AC", r"air[-_ ]?condition|aircon|klima|condicionado|split|heat[-_ ]?pump|waermepumpe|heizung"),
        ("Purifier", "purif|puricare|luftreiniger|purificador"),
    ],
    "MS": [
        ("Monitor", "monitor"),
        ("Laptop", "laptop|gram|notebook"),
        ("Projector", "projector|beamer|cinebeam"),
        ("Audio", r"audio|soundbar|sound[-_ ]?suite|speaker|lautsprecher|xboom|earbuds|kopfhoerer|headphone|tone[-_ ]?free"),
    ],
    "HS": [
        ("Styler", "styler"),
        ("Dishwasher", r"dishwasher|geschirr|\bdw\b"),
        ("Vacuum", "vacuum|cordzero|staubsauger"),
        ("Cooking", "micro|mikrowell|cook|oven|backofen|range|hob|kochfeld"),
        ("Fridge", "fridge|refrigerator|kuehl|kühl|freezer|kimchi"),
        ("Dryer", "dryer|trockner"),
        ("Washer", "wash|wasch|waesche|laundry"),
    ],
}
GROUP_DEFAULT = {"ES": "AC", "MS": "TV", "HS": "Other"}
TV_WITH_SOUND = r"tvs?[-_ ]?(und|and|&)?[-_ ]?soundbar|tvs?-soundbars"
WASH_AND_DRY = r"washtower|waschtrockner|washers?[-_ ]?dryers?|wash[-_ ]?combo|washcombo"

LAYOUTS = {
    "ST0001": "hero_full_width", "ST0002": "hero_full_width", "ST0003": "vertical_stack", "ST0004": "text_over_image",
    "ST0005": "grid_2_column", "ST0007": "grid_3_column", "ST0008": "hero_full_width", "ST0009": "hero_full_width",
    "ST0011": "image_text_left", "ST0013": "image_text_right", "ST0014": "grid_4_column", "ST0016": "accordion",
    "ST0017": "vertical_stack", "ST0018": "carousel", "ST0027": "icon_grid", "ST0031": "grid_2_column",
    "ST0035": "vertical_stack", "ST0036": "tab_content", "ST0038": "text_over_image", "ST0044": "vertical_stack",
    "ST0047": "carousel", "ST0048": "carousel", "ST0049": "vertical_stack", "ST0053": "tab_content",
    "PD0001": "grid_4_column", "PD0003": "vertical_stack", "PD0008": "spec_table", "PD0012": "product_gallery",
    "PD0033": "tab_content", "PD0046": "text_over_image",
}
NOISE_PREFIXES = ["CM", "GN", "AL", "PN", "CS"]
NOISE_IDS = ["PD0001", "PD0002", "PD0004", "PD0006", "PD0044", "PD0056"]
GALLERY_IDS = ["PD0012", "PD0033"]
SPEC_IDS = ["PD0008", "ST0035"]
FAQ_IDS = ["ST0025", "ST0049", "PD0050"]
ANCHOR_IDS = ["ST0018"]
STACK_IDS = ["ST0001", "ST0002"]
AWARD_IDS = ["ST0053"]
MARKETING_IDS = [
    "ST0001", "ST0003", "ST0004", "ST0005", "ST0007", "ST0009", "ST0010", "ST0013", "ST0014", "ST0016", "ST0027", "ST0036",
    "ST0038", "ST0048", "ST0053", "PD0008",
]
BELOW_FOLD_IDS = [
    "PD0002", "PD0004", "PD0006", "PD0033", "PD0056", "PN0002", "ST0025", "CM0001", "CM0002", "CM0007",
]
INVENTORY_SKIP_IDS = NOISE_IDS + GALLERY_IDS + ["ST0010"] + FAQ_IDS
MERGE_LAYOUTS = [
    "hero_full_width", "text_over_image", "image_text_left", "image_text_right", "image_text_side", "vertical_stack", "unknown",
]

JUNK_MEDIA = {
    "inventory": r"(?i)gnb|promotion|promo|deals|banner|membership|favicon|\.svg|[-_]icon[-_]|logo",
    "recover": r"(?i)gnb|promo|deals|banner|membership|favicon|\.svg|[-_]icon[-_]|logo|thum-(165|350)x",
    "crawl": r"(?i)gnb|promotion|promo|deals|installment|home-page|/banner|membership|superbrand|microsite|/logo|favicon"
             r"|\.svg|[-_]icon[-_]",
}
RECOMMENDED_THUMB = r"(?i)renditions/thum-(165x165|350x350)"
ICON_ASSET = r"(?i)icon-on|icon-off|[-_]icon[-_]|[-_]ico[-_]|[-_]thumbnail[-_]|[-_](on|off)\.(png|jpe?g)$|\.svg(\?|$)"
ICON_PATH = r"(?i)\.svg($|\?)|/icon"
AWARD_FILE = (
    r"(?i)(badge|award(?![-_ ]?winning)|reddot|red[-_]dot|testurteil|editors?[-_]?choice|best[-_]?of[-_]?(the[-_]?best|ces|show)"
    r"|winner)"
)
TEST_SEAL = r"(?i)test[-_ %20]*(siegel|urteil|sieger)|best[-_ %20]*picks?"
STOP_HEADING = (
    r"(?i)^(Summary|Dimensions|All Specs?\b|Specs?$|Key Spec|PRODUCT (FEATURES|SPECIFICATIONS)|Rating|Overall Rating|Review"
    r"|Average Customer|Customer Images|Filter Reviews|Pros$|Cons$|Our picks|Need help|Contact|Find locally|Support|Warranty"
    r"|FAQ|Product Support)"
)
CHROME_HEADING = (
    r"(?i)^(AI recommend|Quick Links|(?-i:{vendor})s Pick|Popularity ranking|Recommended|Recently Viewed|You may also like"
    r"|What people are saying|Compare|Where to buy|Find a store|Related)"
)


def chrome_heading(vendor: str = "[A-Z]{2,}") -> str:
    """Headings of navigation and recommendations; vendor is a pattern for the brand, in capitals as it stands unless given otherwise."""
    return CHROME_HEADING.replace("{vendor}", vendor)


BLOCK_PAGE = r"(?i)access denied|you don't have permission to access|reference\s*#\d|request blocked|are you a robot"
SYNC_EXCLUDE = [
    r"(^|/)tiles/", r"(^|/)(pc|mobile)_full\.png$", r"\.bak$", r"\.log$", r"(^|/)progress\.json$",
    r"(^|/)[a-z_]+_content\.html$", r"(^|/)\.DS_Store$", r"(^|/)\.imgdims-cache\.json$", r"^_trash/",
]
POLICY_RULES = [
    ("tag", r"(?i)<\s*(script|iframe|object|embed|form|input|button|link|meta|base)\b"),
    ("handler", r"(?i)\son[a-z]+\s*="),
    ("javascript", r"(?i)javascript\s*:"),
    ("http_equiv", r"(?i)http-equiv"),
]


def _ladder(value: Column, rules: list[tuple[str, str]], default: Column | str) -> Column:
    out = None
    for label, pattern in rules:
        hit = value.rlike("(?i)" + pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def classify(url: Column | str, sub: Column | str | None = None) -> Column:
    """Struct(cat, sub, dv, grp) of a product address; an address that does not parse gives NULL fields.

    Each step feeds many rules of the next one, so it is bound once per row.
    """
    u = _c(url)

    def start(segs: Column) -> Column:
        second = F.coalesce(F.try_element_at(segs, F.lit(2)), F.lit(""))
        before_last = F.coalesce(F.try_element_at(segs, F.lit(-2)), second)
        first = F.struct(
            segs.isNotNull().alias("ok"), _ladder(u, CATEGORY_RULES, title_case(second)).alias("cat"),
            (title_case(before_last) if sub is None else _c(sub)).alias("sub"), _drop(_text(u), "^https?://[^/]+").alias("tail"),
        )
        return let(first, divide)

    def divide(x: Column) -> Column:
        key = F.concat_ws(" ", x["cat"], x["sub"], x["tail"])
        dv = F.when(x["cat"] == "Air", "ES").otherwise(let(key, lambda k: _ladder(k, DIVISION_RULES, "HS")))
        return let(
            F.struct(x["ok"].alias("ok"), x["cat"].alias("cat"), x["sub"].alias("sub"), dv.alias("dv"), F.lower(key).alias("low"),
                     F.lower(F.concat_ws(" ", x["sub"], x["tail"])).alias("own")),
            group,
        )

    def group(x: Column) -> Column:
        grp = None
        for division, ladder in GROUP_RULES.items():
            for label, pattern in ladder:
                hit = (x["own"] if label == "Dryer" else x["low"]).rlike(pattern)
                if label == "Audio":
                    hit = hit & ~x["low"].rlike(TV_WITH_SOUND)
                if label == "Dryer":
                    hit = hit & ~x["own"].rlike(WASH_AND_DRY)
                hit = (x["dv"] == division) & hit
                grp = F.when(hit, label) if grp is None else grp.when(hit, label)
        for division, label in GROUP_DEFAULT.items():
            grp = grp.when(x["dv"] == division, label)
        fields = (("cat", x["cat"]), ("sub", x["sub"]), ("dv", x["dv"]), ("grp", grp))
        return F.struct(*[F.when(x["ok"], v).alias(n) for n, v in fields])

    return let(path_segments(u), start)


def channel_guess(file: Column | str, labels: Column | str) -> Column:
    text = F.lower(F.concat_ws(" ", _text(file), _text(labels)))
    return (
        F.when(text.rlike("shopee|et_title|mass_update|ps_product"), "shopee")
        .when(text.rlike("lazada|sellersku|lorikeet|catid"), "lazada")
        .otherwise("")
    )


def layout_of(component_id: Column | str, column_count: Column | str) -> Column:
    """Declared columns 2..4 win, then the id table, then unknown."""
    table = F.create_map(*[F.lit(x) for pair in LAYOUTS.items() for x in pair])
    cc = F.coalesce(_c(column_count), F.lit(0))
    return F.when(cc.isin(2, 3, 4), F.concat(F.lit("grid_"), cc.cast("string"), F.lit("_column"))).otherwise(
        F.coalesce(F.try_element_at(table, _c(component_id)), F.lit("unknown"))
    )


def component_bucket(component_id: Column | str) -> Column:
    """content, gallery, anchor or noise."""
    cid = F.upper(_text(component_id))
    return (
        F.when(F.substring(cid, 1, 2).isin(NOISE_PREFIXES) | cid.isin(NOISE_IDS), "noise")
        .when(cid.isin(GALLERY_IDS), "gallery")
        .when(cid.isin(ANCHOR_IDS), "anchor")
        .otherwise("content")
    )


def is_junk_media(url: Column | str, rule: str) -> Column:
    return _text(url).rlike(JUNK_MEDIA[rule])


def media_role(url: Column | str, strict: bool = False) -> Column:
    return F.when(_text(url).rlike(ICON_ASSET if strict else ICON_PATH), "icon").otherwise("content")


def usable_media(url: Column | str, role: Column | str | None = None) -> Column:
    low = F.lower(_no_query(url))
    ok = (_text(url) != "") & ~low.rlike(r"\.(mp4|webm|mov)$|[_-](on|off)\.(png|jpe?g)$") & ~F.lower(_text(url)).rlike(r"thum-\d+x\d+")
    return ok & (F.coalesce(_c(role), F.lit("")) != "icon") if role is not None else ok


def is_award(url: Column | str) -> Column:
    return file_name(url).rlike(AWARD_FILE) | file_name(url).rlike(TEST_SEAL) | _no_query(url).rlike("(?i)/awards?/")


def renderable(has_text: Column, has_image: Column, has_specs: Column) -> Column:
    return (has_text & has_image) | has_specs


def is_intro(roles: Column | str, has_media: Column, has_specs: Column, component_id: Column | str) -> Column:
    """A text-only opening with a headline, short enough to stand alone."""
    r = F.coalesce(_c(roles), F.array().cast("array<struct<role:string,text:string>>"))
    chars = F.aggregate(
        F.filter(r, lambda x: x["role"] != "disclaimer"), F.lit(0), lambda acc, x: acc + F.length(x["text"])
    )
    return (
        ~has_media & ~has_specs & ~_text(component_id).isin(FAQ_IDS)
        & F.exists(r, lambda x: x["role"] == "headline") & (chars <= 1200)
    )


def drop_block_text(text: Column | str) -> Column:
    return trim_ws(F.array_join(F.filter(F.split(_text(text), "\n"), lambda ln: ~ln.rlike(BLOCK_PAGE)), "\n"))


def truncate_md(md: Column | str, boundary: Column | str) -> Column:
    """Cut the text at a boundary heading that stands past 30 % of it."""
    m, b = _text(md), _text(boundary)
    probe = trim_ws(F.left(F.element_at(F.split(b, "\n"), 1), F.lit(40)))
    at = F.instr(m, probe)
    return F.when((F.length(b) >= 6) & (at - 1 > F.length(m) * 0.3), _drop(F.left(m, at - 1), r"\s+$")).otherwise(m)


def is_syncable(rel: Column | str) -> Column:
    return ~_text(rel).rlike("|".join(SYNC_EXCLUDE))


def policy_violations(html: Column | str) -> Column:
    """ARRAY<STRUCT<rule,n>> of active content found in a fragment."""
    found = [F.struct(F.lit(name).alias("rule"), F.regexp_count(_text(html), F.lit(p)).alias("n")) for name, p in POLICY_RULES]
    return F.filter(F.array(*found), lambda v: v["n"] > 0)


def page_check(html: Column | str, url: Column | str, root: str = "/content", min_len: int = 5000) -> Column:
    """Struct(ok, reason): is this the product page that was asked for?"""
    h = _text(html)
    want = F.lower(_drop(_text(path_of(url)), "/+$"))
    hrefs = [
        r'<link[^>]+rel="canonical"[^>]*href="([^"]+)"', r'<link[^>]+href="([^"]+)"[^>]*rel="canonical"',
        r'property="og:url"\s+content="([^"]+)"', r'content="([^"]+)"\s+property="og:url"',
    ]
    found = F.filter(
        F.array(*[F.lower(_drop(_text(path_of(F.regexp_extract(h, p, 1))), "/+$")) for p in hrefs]), lambda p: p != ""
    )
    got = F.try_element_at(found, F.lit(1))
    tail = lambda p: F.element_at(F.split(p, "/"), -1)
    head = lambda p: F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(2)), F.lit(""))
    same = (got == want) | ((tail(got) == tail(want)) & (head(got) == head(want)))
    low = F.replace(F.lower(h), F.lit("\\/"), F.lit("/"))
    segs = path_segments(url)
    cc = F.coalesce(F.try_element_at(segs, F.lit(1)), F.lit(""))
    repo = F.concat(
        F.lit(root), F.lit("/"), cc, F.lit("/"), cc, F.lit("/"),
        F.lower(F.array_join(F.slice(segs, 2, F.greatest(F.size(segs), F.lit(1))), "/")), F.lit("/"),
    )
    seg = tail(want)
    times = F.floor((F.length(low) - F.length(F.replace(low, seg, F.lit("")))) / F.greatest(F.length(seg), F.lit(1)))
    reason = (
        F.when(F.length(h) < min_len, F.concat(F.lit("too short: "), F.length(h).cast("string")))
        .when(h.rlike(BLOCK_PAGE) & ~F.contains(h, F.lit("__next_f")), "block page")
        .when(got.isNotNull(), F.when(same, "").otherwise("different page"))
        .when(F.contains(low, repo), "")
        .when((seg != "") & (times >= 3), "")
        .otherwise("not the requested product page")
    )
    return F.struct((reason == "").alias("ok"), reason.alias("reason"))


def site_code_ok(site: Column | str) -> Column:
    return _text(site).rlike(SITE_CODE)


def model_key_ok(url: Column | str) -> Column:
    """The last segment looks like a model code: 4+ characters with a letter and a digit."""
    from .urls import norm_key

    k = norm_key(last_segment(url))
    return (F.length(k) >= 4) & k.rlike(r"\d") & k.rlike("[A-Z]")


def product_title(html: Column | str) -> Column:
    """First usable of og:title (text before the bar), h1, title."""
    from .text import unescape_basic

    h = _text(html)
    raw = [
        F.regexp_extract(h, r'(?is)property="og:title"\s+content="([^"|]*)', 1),
        F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1),
        F.element_at(F.split(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\|"), 1),
    ]
    ready = [F.trim(F.regexp_replace(unescape_basic(_drop(t, "<[^>]+>")), r"\s+", " ")) for t in raw]
    return F.coalesce(
        F.try_element_at(F.filter(F.array(*ready), lambda t: (F.length(t) >= 5) & ~t.rlike(BLOCK_PAGE)), F.lit(1)), F.lit("")
    )
