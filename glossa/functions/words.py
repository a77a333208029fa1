"""Column expressions over words, keys, routes and digests. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Generated keys begin with these, so that no headword can meet one.
KEY_PREFIX, ROUTE_PREFIX, CLASS_PREFIX = "__glossa_", "glo-", "glo_"
MAX_KEY_BYTES = 255


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(word, UPPER, LOWER)


def order_key(word: Column) -> list[Column]:
    """Dictionary order: bytes with A-Z folded, then raw bytes."""
    return [ascii_lower(word), word]


def key_ok(word: Column) -> Column:
    """A dictionary key: 1 to 255 bytes, no control character."""
    return F.octet_length(word).between(1, MAX_KEY_BYTES) & ~word.rlike(r"\p{Cc}")


def headword_ok(word: Column) -> Column:
    """A key that is not of the reserved, generated kind."""
    return key_ok(word) & ~word.startswith(KEY_PREFIX)


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def routing_key(namespace: Column, entry_id: Column) -> Column:
    """The generated key of an entry of a compiled book."""
    return F.concat(F.lit(KEY_PREFIX), namespace, F.lit("_entry_"), F.lpad(F.lower(F.hex(entry_id)), 16, "0"))


def entry_route(namespace: Column, entry_id: Column) -> Column:
    return F.concat(F.lit(ROUTE_PREFIX), namespace, F.lit("-e"), entry_id.cast("string"))


def page_route(namespace: Column, page_id: Column) -> Column:
    return F.concat(F.lit(ROUTE_PREFIX), namespace, F.lit("-p"), page_id.cast("string"))


def is_internal_key(word: Column) -> Column:
    """A generated key, with or without a fragment."""
    key = F.split_part(word, F.lit("#"), F.lit(1))
    return key.rlike(f"^({KEY_PREFIX}[0-9a-f]{{64}}_entry_[0-9a-f]{{16}}|{ROUTE_PREFIX}[0-9a-f]{{64}}-[ep][0-9]+)$")


def scope_class(namespace: Column) -> Column:
    return F.concat(F.lit(CLASS_PREFIX), F.left(namespace, F.lit(16)))


def browser_path(file: Column) -> Column:
    return F.concat(F.lit("content/"), file, F.lit(".html"))


def browser_anchor(entry_id: Column) -> Column:
    return F.concat(F.lit("glo-entry-"), entry_id.cast("string"))


#: Labels by language.
LABELS = {
    "en": {"supplement": "supplement %d", "chapter": "[Chapter %06d] ", "covers": "Covers", "images": "Images", "untitled": "Dictionary"},
    "zh": {"supplement": "补充 %d", "chapter": "[章节 %06d] ", "covers": "封面", "images": "图片", "untitled": "词典"},
}


def label(lang: Column, kind: str, *args: Column) -> Column:
    """The label of a kind in the row's language; English for an unknown one."""
    out = F.format_string(LABELS["en"][kind], *args)
    return F.when(lang == "zh", F.format_string(LABELS["zh"][kind], *args)).otherwise(out)


def title_or_label(title: Column, lang: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), label(lang, "untitled"))


#: Leading bytes (hex) of image formats, file extension and media type.
IMAGES = (("89504E470D0A1A0A", "png", "image/png"), ("FFD8FF", "jpg", "image/jpeg"), ("474946383761", "gif", "image/gif"), ("474946383961", "gif", "image/gif"), ("424D", "bmp", "image/bmp"))


def image_type(data: Column) -> Column:
    """(ext, media_type) by the leading bytes; null for anything else."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.lit(None).cast("struct<ext:string,media_type:string>")
    for magic, ext, media in reversed(IMAGES):
        out = F.when(head.startswith(magic), F.struct(F.lit(ext).alias("ext"), F.lit(media).alias("media_type"))).otherwise(out)
    return out


def image_file(recindex: Column, data: Column) -> Column:
    return F.concat(F.format_string("image-%06d.", recindex), image_type(data)["ext"])


def data_uri(media_type: Column, data: Column) -> Column:
    """Image bytes as a data URI; base64 without line breaks."""
    return F.concat(F.lit("data:"), media_type, F.lit(";base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def be(data: Column, at: int, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes at a 0-based offset; null if the bytes are not there."""
    part = F.substring(data, at + 1, n)
    kind = "decimal(20,0)" if n > 7 else "bigint"
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast(kind))


def escape_html(text: Column, apostrophe: bool = True) -> Column:
    """Escape for text and attributes; with ``apostrophe`` the five-character form."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")] + [("'", "&#39;")] * apostrophe
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_basic(text: Column) -> Column:
    """The six named references that attributes may use; the ampersand comes last."""
    for a, b in (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def rewrite_br(html: Column, by: str) -> Column:
    """Lower-case line breaks in any of their four spellings."""
    return F.regexp_replace(html, "<br ?/?>", by)


#: Readers, and whether they take the stylesheet as a linked file or inline.
READERS = (("koreader", True, False), ("goldendict", True, False), ("goldendict-mobile", False, True), ("readest", False, True), ("kobo", False, True), ("universal", True, True))


def style_prefix(link: Column, inline: Column, css: Column) -> Column:
    """What goes before each payload: a link, then an inline copy, as delivery asks; nothing for empty CSS."""
    a = F.when(link, F.lit('<link rel="stylesheet" type="text/css" href="dictionary.css">')).otherwise("")
    b = F.when(inline, F.concat(F.lit("<style>"), css, F.lit("</style>"))).otherwise("")
    return F.when(F.coalesce(css, F.lit("")) == "", "").otherwise(F.concat(a, b))
