"""Text of pages and names: images of HTML, labels, templates, inline Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that may name an image in full size, in the order in which they count.
FULL_SIZE = ["data-original", "data-src-large", "data-large", "data-large-file", "data-full", "data-full-src", "data-hi-res", "data-highres", "data-zoom-image", "data-image", "data-lazy-src", "data-lazy", "data-src", "data-srcset"]


#: Characters that a review label must not hold as they are.
UNSAFE = r"[\x00-\x1f\x7f-\x9f\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"


def best_of_srcset(srcset: Column) -> Column:
    """The candidate with the largest width, or density times 1000; the first of equals; without either it counts 1."""
    parts = F.filter(F.transform(F.split(srcset, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.get(p, F.lit(0)) != "")
    number = lambda p: F.coalesce(F.regexp_extract(F.get(p, F.lit(1)), r"^([0-9.]+)", 1).try_cast("double"), F.lit(1.0))
    score = lambda p: F.when(F.get(p, F.lit(1)).endswith("w"), number(p)).when(F.get(p, F.lit(1)).endswith("x"), number(p) * 1000).otherwise(1.0)
    ranked = F.transform(parts, lambda p, i: F.struct(score(p).alias("s"), (-i).alias("i"), F.get(p, F.lit(0)).alias("u")))
    return F.array_max(ranked)["u"]


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag's text, or null."""
    return F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*[\"']([^\"']*)[\"']", 1), F.lit(""))


def full_image(tag: Column, link: Column | None = None) -> Column:
    """The best address that an image tag names: full-size attributes, then srcset, then a link around it to an image,
    then src."""
    tries = [best_of_srcset(attribute(tag, a)) if a == "data-srcset" else F.when(~attribute(tag, a).rlike("(?i)^data:"), attribute(tag, a)) for a in FULL_SIZE]
    around = [] if link is None else [F.when(link.rlike(r"(?i)\.(jpe?g|png|gif|webp|avif)(\?|$)"), link)]
    return F.coalesce(*tries, best_of_srcset(attribute(tag, "srcset")), *around, attribute(tag, "src"))


def tags(html: Column, name: str) -> Column:
    """The opening tags of a name in a page, as text. Pages are matched, not parsed: tags inside comments count too."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<{name}\b[^>]*>)"), F.lit(1))


def plain_label(text: Column) -> Column:
    """A label in lower case without bracketed parts and digits, spaces folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\([^)]*\)|\[[^\]]*\]|\d+", " "), r"\s+", " "))


def normalised_text(text: Column) -> Column:
    """A label that counts up or down stays equal: lower case, white space folded, without bracketed parts and digits."""
    folded = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[(\[{].*?[)\]}]", ""), r"[0-9]+", ""))


def label_matches(text: Column, wanted: list[str], unwanted: list[str]) -> Column:
    """Whether a label matches one of the wanted patterns and none of the unwanted."""
    t = plain_label(text)
    return F.coalesce(~t.rlike("|".join(f"(?:{p})" for p in unwanted) or "$^") & t.rlike("|".join(f"(?:{p})" for p in wanted)), F.lit(False))


def mentions(text: Column, words: list[str], exceptions: list[str]) -> Column:
    """Whether a title holds one of the words, in any case, and is none of the exceptions."""
    low = F.lower(text)
    held = F.lit(False)
    for w in words:
        held = held | low.contains(w.lower())
    return F.coalesce(held & ~low.isin([e.lower() for e in exceptions]), F.lit(False))


def conversation_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})", 1), F.lit(""))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A file name template with ``{name}`` tokens: unknown values are empty, their separators go, slashes within values
    become ``_`` and the result never begins with a slash."""
    out = F.lit(template)
    for name, value in values.items():
        clean = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r'[<>:"/\\|?*]', "_")
        out = F.replace(out, F.lit("{" + name + "}"), clean)
    out = F.regexp_replace(out, r"\{[^}]*\}", "")
    out = F.regexp_replace(F.regexp_replace(out, r"[-_ ]*x(?=\.)", ""), r"[-_ ]+(?=\.|/|$)", "")
    return F.regexp_replace(F.regexp_replace(out, "/+", "/"), "^/", "")


def clamped_path(path: Column, most: int) -> Column:
    """A path of at most ``most`` characters where its last segment can give them up: the stem is cut, not the extension."""
    folder, name = F.regexp_extract(path, r"^(.*/)?", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    extension = F.regexp_extract(name, r"(\.[A-Za-z0-9]{1,5})$", 1)
    room = F.greatest(F.lit(1), F.lit(most) - F.length(folder) - F.length(extension))
    return F.when(F.length(path) <= most, path).otherwise(F.concat(folder, F.substring(name, F.lit(1), F.least(room, F.length(name) - F.length(extension))), extension))


def markdown_inline(text: Column) -> Column:
    """Bold, italics, code and links of a Markdown text as HTML, special characters escaped first."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for pattern, new in ((r"`([^`]+)`", "<code>$1</code>"), (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"), (r"\*([^*]+)\*", "<em>$1</em>"), (r"\[([^\]]+)\]\(([^)\s]+)\)", '<a href="$2">$1</a>')):
        out = F.regexp_replace(out, pattern, new)
    return out


def display_safe(text: Column) -> Column:
    """A text whose control and direction marks are written out, for logs and reports: tab, line feed and carriage return by
    their letters, others as four hex digits."""
    digits = lambda c: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c).cast("bigint"))), 4, "0"))
    one = lambda c: F.when(c == "\t", F.lit("\\t")).when(c == "\n", F.lit("\\n")).when(c == "\r", F.lit("\\r")).when(c.rlike(UNSAFE), digits(c)).otherwise(c)
    return F.when(text.rlike(UNSAFE), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many or one + "s"))
