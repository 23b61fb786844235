"""Text columns: markdown clean-up, scene-description detection, disclaimers, typed lines."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import _c, _drop, _text, js_or

LINE_BREAK = " "
NAMED_CHARACTERS = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}
HEADLINE_MAX = 70
EYEBROW_MAX = 40

# Word patterns that mark text a shopper never sees.
MD_IMAGE = r"!\[[^\]]*\]\([^)]*\)"
MD_HEAD = r"^#{1,6}\s*"
SCENE_STRONG = (
    r"(?i)^\s*(this|these|the|an?|its?)\s+(image|images|photo|picture|graphic|graphics|illustration|screenshot|screen\s*shot"
    r"|visual|scene|animation|gif|close-?up|shot|render|diagram)\b"
    r"|\b(image|images|photo|picture|graphic|screenshot|animation|scene)\s+(shows?|showing|of|depicts?|depicting|displays?"
    r"|displaying|illustrat\w*|features?|captures?|portrays?|represents?)\b"
    r"|\billustrat(?:ing|es|e|ion)\b|\bdepict(?:ing|s|ed)\b"
)
SCENE_NARRATIVE = (
    r"(?i)\b(is|are)\s+shown\b|\bis\s+displayed\b|\bis\s+pictured\b|\b(can\s+be|is|are)\s+seen\b|\bappears?\s+(on|in|as)\b"
    r"|\blooks?\s+(powered|like|as if)\b|\bshown\s+(in|on)\b|\b(is|are)\s+placed\b|\b(is|are)\s+connected\b"
    r"|\b(is|are)\s+displaying\b|\bworks?\s+at\b|\bwhile\s+\w+ing\b|\bthen\b.*\bturns?\s+on\b"
    r"|\bin\s+a\s+(studio|bright|dark|modern|cozy|living|dining)\b"
)
SCENE_START = r"(?i)^(a|an|the|this|these|those|two|three|several|both|its?)\b"
SCENE_WORDS = (
    r"(?i)\b(laptop|smartphone|phone|tablet|screen|display|interface|monitor|desk|table|wall|sofa|couch|room|kitchen|bathroom"
    r"|bedroom|studio|background|family|children|grandparent|parent|man|woman|men|women|person|people|couple|kid|boy|girl|user"
    r"|hand|hands|shows?|showing|displays?|displaying|depicts?|placed|positioned|connected|sits?|sitting|stands?|standing"
    r"|holds?|holding|wearing|playing|watching|indicating|highlighting|featuring|illustrating|both|while"
    r"|in a|on a|on the|in the|next to|in front of)\b"
)
READER_START = (
    r"(?i)^(the|this|an?|a)\s+(image|images|animation|animations|scene|photo|photograph|graphic|illustration|screenshot|picture"
    r"|visual|close[- ]?up|split[- ]?screen|laptop|person|screen|background|diagram|infographic|render(?:ing)?)\b"
)
READER_VERB = (
    r"(?i)\b(show|shows|showing|feature|features|featuring|display|displays|displaying|highlight|highlights|highlighting"
    r"|illustrat\w+|depict\w+|emphasi[sz]\w+|showcas\w+|represent\w+|symboli[sz]\w+|portray\w+)\b"
)
CTA_LINE = (
    r"(?i)^(learn more|see more|view more|read more|show (more|less)|discover( more)?|find out more|explore( more)?|shop now"
    r"|buy( now)?|order now|add to cart|watch( now| the full movie| video)?|play( video)?|pause|previous|next|close"
    r"|tab \d+|slide \d+|더보기|자세히( 보기)?|구매(하기)?|장바구니)\.?$"
)
FOOTNOTE_REF = r"(?<=[A-Za-z가-힣.,])\d{1,2}\)"
UI_CONTROL = (
    r"(?i)(?:ก่อนหน้า|ถัดไป|previous|next|zurück|weiter)?\s*"
    r"(?:วิดีโอ(?:หยุดชั่วคราว|กำลังเล่น|เล่น)|video\s+(?:paused|playing|play)|video\s+(?:pausiert|wiedergabe))"
)
UI_TABS = [
    "สรุป", "สเปคทั้งหมด", "ข้อมูลจำเพาะทั้งหมด", "summary", "all specs", "all specifications", "zusammenfassung",
    "alle spezifikationen",
]
UI_WORDS = r"(?i)^(play video|pause video|previous slide|next slide|close|toggle contents|close contents)$"
BANNED_SYMBOLS = (
    "[®™℠©℗]|[*＊∗✱⁎]|[†‡§¶※⁂]|[¹²³⁰ⁱ⁴-ⁿ]|[•‣■-◿★☆]|[←-⇿➔-➿]|[☀-⛿✀-➓]|[\\x{FE0F}\\x{200B}-\\x{200D}\\x{FEFF}]"
    "|[\\x{1F000}-\\x{1FAFF}]"
)
PROMO = (
    r"(?i)\bsave up to\b|\d+\s*%\s*(off|discount)|\bpurchase two\b|\bbuy (more|two|\d)|\bcashback\b|\bvoucher\b"
    r"|\bsparen sie\b|\brabatt\b|\bgutschein\b|ส่วนลด|ลดสูงสุด"
)
# Page furniture recognised by substring.
SKIP_WORDS = [
    "cookie", "consent", "privacy policy", "manage preference", "we use cookies", "gdpr", "terms of use", "sign in", "sign up",
    "log in", "create account", "register", "newsletter", "subscribe", "navigation", "skip to", "go to homepage", "can't find",
    "page you requested", "page isn't available", "search", "cart", "checkout", "wishlist", "breadcrumb", "page not",
    "we're sorry", "view all", "see all", "load more", "show more", "sort by", "filter", "results", "write a review",
    "customer review", "questions?", "let us help", "contact us", "find locally", "find nearby", "store locator",
    "find a store", "product support", "manuals", "limited quantity", "almost sold out", "add to cart", "summary-member",
    "buy now", "shop now", "recommended product", "related product", "you may also", "customers also", "people also",
    "required field", "ratings", "write your review", "overall rating", "geolocation", "get directions", "directions to",
    "limited time", "offer expires", "check your final price", "final price", "what people are saying", "customer rating",
    "be the first to review", "first to review", "add to compare", "remove compare", "to properly experience",
    "use an alternate browser", "response to coronavirus", "covid", "passwords must", "characters left", "component-obs",
    "iw_component", "component-update", "learn more", "experience this product around", "ar experience", "view in your room",
    "view in room", "360° view", "share this page", "share on", "follow us", "our picks for you", "picks for you",
    "need more help", "more help with your product", "discover our latest", "latest promotions", "latest offers",
    "see all promotions", "view promotions", "frequently asked", "all spec", "best qned tv for", "gaming portal turns",
    "find an installer", "need help?",
]
ABSENT_VALUE = r"(?i)^\s*(ไม่|ไม่มี|no|none|-)\s*$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a large input is not copied into every place that reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column | str) -> Column:
    return F.split(_text(text), "\n")


def clean_line(line: Column | str) -> Column:
    bare = _drop(_drop(_drop(F.trim(_text(line)), MD_IMAGE), MD_HEAD), r"^[-*+]\s+")
    return F.trim(F.regexp_replace(bare, r"(?s)^\*\*(.+)\*\*$", "$1"))


def _describes_scene(raw: Column) -> Column:
    def judge(t: Column) -> Column:
        dense = t.rlike(SCENE_START) & (F.regexp_count(t, F.lit(SCENE_WORDS)) >= 2)
        return (F.length(t) >= 40) & (t.rlike(SCENE_STRONG) | t.rlike(SCENE_NARRATIVE) | dense)

    return let(F.trim(_drop(clean_line(raw), r"\.+$")), judge)


def is_image_description(text: Column | str) -> Column:
    """Alt-style scene text: inside a markdown image, or as a long descriptive sentence of its own."""
    def judge(raw: Column) -> Column:
        alts = F.regexp_extract_all(raw, F.lit(r"!\[([^\]]*)\]"), 1)
        return (raw.rlike(MD_IMAGE) & F.exists(alts, _describes_scene)) | _describes_scene(raw)

    return let(F.trim(_text(text)), judge)


def content_lines(text: Column | str) -> Column:
    kept = F.filter(lines_of(text), lambda ln: ~is_image_description(ln))
    return F.filter(F.transform(kept, clean_line), lambda ln: (ln != "") & ~is_image_description(ln))


def strip_descriptions(text: Column | str) -> Column:
    kept = F.filter(lines_of(text), lambda ln: ~is_image_description(ln))
    shown = F.filter(
        F.transform(kept, lambda ln: F.struct(ln.alias("raw"), _drop(ln, MD_IMAGE).alias("out"))),
        lambda s: (F.trim(s["out"]) != "") | (F.trim(s["raw"]) == ""),
    )
    return trim_ws(F.array_join(F.transform(shown, lambda s: s["out"]), "\n"))


def trim_ws(value: Column | str) -> Column:
    """Trim all white space, not only blanks."""
    return _drop(_text(value), r"^\s+|\s+$")


def clean_one_line(line: Column) -> Column:
    """Cleaned line, or NULL where the whole line goes. Blank lines pass."""
    gone = F.lit(None).cast("string")

    def cell_of(s: Column) -> Column:
        cell = F.trim(F.replace(F.regexp_extract(s, r"^\|(.+)\|$", 1), F.lit("|"), F.lit(" ")))
        return let(cell, lambda c: F.when(~c.rlike(r"^[\s:-]*$"), c))

    def prose(raw: Column) -> Column:
        odd = F.regexp_count(raw, F.lit(r"\*\*")) % 2 == 1
        plain = _drop(F.when(odd, F.replace(raw, F.lit("**"), F.lit(""))).otherwise(raw), FOOTNOTE_REF)
        return F.nullif(_drop(plain, r"\s+$"), F.lit(""))

    def judge(s: Column) -> Column:
        return (
            F.when(s == "", "")
            .when(s.startswith("|") | s.rlike(r"^[\s:|-]+$"), F.when(s.rlike(r"^\|?[\s:|-]*\|?$"), gone).when(
                s.rlike(r"^\|(.+)\|$"), cell_of(s)).otherwise(prose(line)))
            .when((F.length(s) >= 40) & s.rlike(READER_START) & s.rlike(READER_VERB), gone)
            .when(s.rlike(CTA_LINE), gone)
            .otherwise(prose(line))
        )

    return let(trim_ws(line), judge)


def clean_text_lines(text: Column | str) -> Column:
    kept = F.filter(F.transform(lines_of(text), clean_one_line), lambda ln: ln.isNotNull())
    return trim_ws(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def norm_compare(text: Column | str) -> Column:
    """Comparison key: marks and every white space removed, lower case."""
    return F.lower(_drop(_drop(_text(text), r"[™®©*​ ]"), r"\s+"))


def squash(text: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(text), r"\s+", " ")))


def only_ui(text: Column | str, blob: Column | str) -> Column:
    """The text is a tab label, or control words around captions the blob already holds."""
    t = trim_ws(text)
    parts = F.filter(F.transform(F.split(t, UI_CONTROL), norm_compare), lambda p: F.length(p) >= 2)
    tabs = norm_compare(t).isin([label.replace(" ", "") for label in UI_TABS])
    return tabs | (t.rlike(UI_CONTROL) & F.forall(parts, lambda p: F.contains(_text(blob), p)))


def unescape_basic(text: Column | str) -> Column:
    """Character references decoded in one pass: the names of HTML 4, `&apos;`, and numbers in either base; others stay as they are."""
    names = F.from_json(F.lit(json.dumps(NAMED_CHARACTERS)), "map<string,string>")

    def character(digits: Column, base: int) -> Column:
        bare = F.regexp_replace(digits, "^0+(?=.)", "")
        code = F.when(F.length(bare) <= 7, F.conv(bare, base, 10).cast("int"))
        known = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")

    def decoded(part: Column) -> Column:
        whole = F.regexp_extract(part, "^&(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;)", 0)
        digits = F.regexp_extract(whole, "[0-9a-fA-F]+", 0)
        sign = F.when(whole.rlike("^&#[xX]"), character(digits, 16)).when(whole.startswith("&#"), character(digits, 10)).otherwise(
            F.try_element_at(names, F.regexp_extract(whole, "[A-Za-z0-9]+", 0)))
        return F.when(sign.isNotNull(), F.concat(sign, F.substr(part, F.length(whole) + 1))).otherwise(part)

    t = _text(text)
    return F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "(?=&)"), decoded), "")).otherwise(t)


def plain_html(html: Column | str, keep_line_breaks: bool = False, bullet: str = "- ") -> Column:
    s = F.regexp_replace(_text(html), r"(?i)<br\s*/?>", LINE_BREAK if keep_line_breaks else "\n")
    s = F.regexp_replace(s, r"(?i)</(p|div|li|h\d)>", "\n")
    s = _drop(F.regexp_replace(s, r"(?i)<li[^>]*>", bullet), "<[^>]+>")
    s = F.replace(unescape_basic(s), F.lit(" "), F.lit(" "))
    rows = F.transform(F.split(s, "\n"), lambda ln: F.trim(F.regexp_replace(ln, r"[ \t\r]+", " ")))
    return trim_ws(F.regexp_replace(F.array_join(rows, "\n"), r"\n{2,}", "\n"))


def is_disclaimer_line(line: Column | str, numbered: bool = False) -> Column:
    s = trim_ws(line)
    mark = (s.startswith("*") & ~s.startswith("**")) | s.startswith("※")
    return mark | s.rlike(r"^\d+\s*[).]\s*") if numbered else mark


def split_disclaimers(text: Column | str, numbered: bool = False) -> Column:
    """Struct(disclaimer, normal): the two groups of lines, each in order."""
    rows = F.filter(lines_of(text), lambda ln: trim_ws(ln) != "")
    return F.struct(
        F.array_join(F.filter(rows, lambda ln: is_disclaimer_line(ln, numbered)), "\n").alias("disclaimer"),
        F.array_join(F.filter(rows, lambda ln: ~is_disclaimer_line(ln, numbered)), "\n").alias("normal"),
    )


def split_disclaimer_blob(text: Column | str) -> Column:
    pieces = F.flatten(
        F.transform(F.split(_text(text), LINE_BREAK + "+"), lambda p: F.split(trim_ws(p), r"\s+(?=[*※]\S)"))
    )
    return F.array_distinct(F.filter(F.transform(pieces, trim_ws), lambda p: p != ""))


def strip_symbols(text: Column | str) -> Column:
    """Marks a retail text policy refuses, with the gaps they leave closed."""
    s = _drop(_drop(_text(text), BANNED_SYMBOLS), r"\(\s*\)")
    s = F.regexp_replace(F.regexp_replace(s, "[ \t ]{2,}", " "), r"[ \t]+([,.;:!?%)\]])", "$1")
    return trim_ws(F.array_join(F.transform(F.split(s, "\n"), trim_ws), "\n"))


def roles_of(text: Column | str) -> Column:
    """Markdown lines to ARRAY<STRUCT<role,text>>; a short first line above a heading is the eyebrow."""
    raw = F.filter(lines_of(text), lambda ln: trim_ws(ln) != "")
    head = lambda ln: trim_ws(ln).rlike(r"^#{1,6}\s*")
    bare = lambda ln: trim_ws(_drop(trim_ws(ln), MD_HEAD))
    second = F.coalesce(F.try_element_at(raw, F.lit(2)), F.lit(""))
    typed = F.transform(
        raw,
        lambda ln, i: F.struct(
            F.when(head(ln), "headline")
            .when((i == 0) & head(second) & (F.length(bare(ln)) <= EYEBROW_MAX), "eyebrow")
            .otherwise("body")
            .alias("role"),
            bare(ln).alias("text"),
            trim_ws(ln).rlike("^[*※]").alias("note"),
        ),
    )
    kept = F.filter(typed, lambda r: (r["text"] != "") & ~r["note"] & ~is_image_description(r["text"]))
    return F.transform(kept, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text")))


def split_headline(text: Column | str) -> Column:
    """Struct(eyebrow, headline, body) of a section text."""
    ls = F.filter(F.transform(lines_of(text), lambda ln: trim_ws(_drop(trim_ws(ln), r"^#+\s*"))), lambda ln: ln != "")
    first, second = (F.coalesce(F.try_element_at(ls, F.lit(i)), F.lit("")) for i in (1, 2))
    lead = (F.size(ls) >= 2) & (F.length(first) <= EYEBROW_MAX) & (F.length(second) > F.length(first))
    tail = lambda n: F.array_join(F.slice(ls, n, F.greatest(F.size(ls), F.lit(1))), "\n")
    return F.struct(
        F.when(lead, first).otherwise("").alias("eyebrow"),
        F.when(lead, second).otherwise(first).alias("headline"),
        F.when(lead, tail(3)).otherwise(tail(2)).alias("body"),
    )


def ufn(name: Column | str, model: Column | str) -> Column:
    """Product name without a trailing model code."""
    n, m = F.trim(_text(name)), F.trim(_text(model))
    tail = F.right(n, F.length(m))
    cut = _drop(F.left(n, F.greatest(F.length(n) - F.length(m), F.lit(0))), r"[\s|,\-–—]+$")
    return F.when((m != "") & (F.lower(tail) == F.lower(m)) & (cut != ""), cut).otherwise(n)


def usp_key(title: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(_text(title), r"[\s™®\-–—:]+", " ")))


def model_from_name(name: Column | str) -> Column:
    return F.regexp_extract(F.trim(_text(name)), r"\|\s*([A-Z0-9][A-Z0-9.\-/]{3,})\s*$", 1)


def is_fragment_heading(text: Column | str) -> Column:
    t = trim_ws(text)
    return t.rlike("^[A-Za-z]{1,4}$") & (t != F.upper(t))


def is_skip(text: Column | str) -> Column:
    pattern = "|".join(rf"\Q{word}\E" for word in SKIP_WORDS)
    return F.lower(F.regexp_replace(_text(text), "[ \t]+", " ")).rlike(pattern)


def looks_like_class_name(text: Column | str) -> Column:
    return trim_ws(text).rlike(r"^[a-zA-Z][a-zA-Z0-9]*(-[a-zA-Z0-9]+)+$|^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]+$")


def looks_like_nav(text: Column | str) -> Column:
    many = F.regexp_count(_text(text), F.lit("\n")) > 3
    return many | trim_ws(text).rlike(r"^[A-Z/&]+(\s[A-Z/&]+)*$")


def clip(text: Column | str, limit: int) -> Column:
    """Leading characters a field may hold."""
    return F.left(_text(text), F.lit(limit))


def pipeline_error(log: Column | str) -> Column:
    """One user-facing line out of a job log."""
    rows = F.filter(
        F.transform(F.split(_drop(_text(log), r"\x1b\[[0-9;]*m"), "\n"), lambda ln: F.trim(ln)), lambda ln: ln != ""
    )
    errors = F.filter(rows, lambda ln: ln.rlike("(?i)error|exception|✗|failed|실패"))
    last = F.coalesce(F.try_element_at(errors, F.lit(-1)), F.try_element_at(rows, F.lit(-1)), F.lit(""))
    short = F.left(F.regexp_replace(last, r"^(?:[\w.]+\.)?(\w*(?:Error|Exception):\s*)", "$1"), F.lit(300))
    return (
        F.when(short.rlike("JSONDecodeError"),
               "The AI analysis returned an incomplete response (this page is very long). Please try again.")
        .when(short.rlike("API_KEY"), "No AI key is set on the server.")
        .when(short.rlike("(?i)declined|refusal"),
              F.concat(F.lit("The AI declined to analyze this page. "), F.left(short, F.lit(120))))
        .when(short.rlike("402|Payment Required"),
              F.concat(F.lit("Page collection failed (key or credits). "), F.left(short, F.lit(120))))
        .when(short.rlike("(?i)429|RESOURCE_EXHAUSTED|quota"), "The AI service quota was exceeded. Please try again later.")
        .otherwise(short)
    )


def fix_info_rows(rows: Column | str) -> Column:
    """ARRAY<STRUCT<label,value>> without absent values and absence notes in parentheses."""
    cleaned = F.transform(
        _c(rows),
        lambda r: F.struct(
            r["label"].alias("label"), F.trim(_drop(r["value"], r"\s*\((?:ไม่มี|ไม่)[^)]*\)")).alias("value")
        ),
    )
    return F.filter(cleaned, lambda r: (r["value"] != "") & ~r["value"].rlike(ABSENT_VALUE))


def tokens(text: Column | str, pattern: str = "[a-z0-9]{3,}") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_text(text)), F.lit(pattern), 0))


__all__ = [name for name in dir() if not name.startswith("_") and name not in ("annotations", "Column", "F", "js_or")]
