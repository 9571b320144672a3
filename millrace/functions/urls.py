"""URL keys, sites and safe file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that say nothing about what a URL names, second-level suffixes, reserved names.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid"]
SIZES = ["w", "h", "width", "height", "size", "resize", "fit", "crop", "quality", "q", "dpr", "auto", "fl", "fm", "format", "maxwidth", "maxheight", "s", "sz", "thumb", "thumbnail"]
CACHES = ["v", "_", "t", "cb", "cache", "ver", "rev"]
SIGNATURES = ["expires", "expiry", "signature", "sig", "token", "policy", "key-pair-id", "x-amz-algorithm", "x-amz-credential", "x-amz-date", "x-amz-expires", "x-amz-security-token", "x-amz-signature", "x-amz-signedheaders"]
TWO_PART = "co|com|org|net|gov|ac|edu"

_SHAPE = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 host, 3 path, 4 query with its mark, 5 fragment with its mark; empty where absent."""
    return F.regexp_extract(url, _SHAPE, k)


def parameters(url: Column, without: list[str], ordered: bool, any_case: bool = False) -> Column:
    """The query string, with its mark, without some parameters and, if ordered, sorted by name and place."""
    pairs = F.filter(F.split(F.substring(part(url, 4), 2, 1 << 30), "&"), lambda p: p != "")
    name = lambda p: F.get(F.split(p, "=", 2), F.lit(0))
    keep = F.filter(pairs, lambda p: ~(F.lower(name(p)) if any_case else name(p)).isin(*without))
    if ordered:
        keep = F.transform(F.array_sort(F.transform(keep, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    return F.when(F.size(keep) > 0, F.concat(F.lit("?"), F.array_join(keep, "&"))).otherwise("")


def link_key(url: Column) -> Column:
    """What a link names: host in lower case, no tracking parameters, no closing slash, fragments only where they route."""
    path = part(url, 3)
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).when(path == "", "/").otherwise(path)
    fragment = F.when(part(url, 5).rlike("^#[/!]"), part(url, 5)).otherwise("")
    return F.when(url.rlike(_SHAPE), F.concat(part(url, 1), F.lit("://"), F.lower(part(url, 2)), path, parameters(url, TRACKING, False), fragment))


def image_key(url: Column) -> Column:
    """What an image URL names whatever its size: https, no size or cache parameters, no size in the path, sorted."""
    path = part(url, 3)
    for pattern, new in ((r"-\d+x\d+(?=\.\w{3,4}$)", ""), (r"-scaled(?=\.\w{3,4}$)", ""), (r"_\d+x\d+(?=\.\w{3,4}$)", ""), (r"/cdn-cgi/image/[^/]+/", "/"), (r"/(resize|fit-in|thumb(nails?|s)?|crop)/\d+x\d+/", "/")):
        path = F.regexp_replace(path, pattern, new)
    path = F.when(path == "", "/").otherwise(path)
    return F.when(url.rlike(_SHAPE), F.concat(F.lit("https://"), F.lower(part(url, 2)), path, parameters(url, SIZES + CACHES, True))).otherwise(url)


def resolve(link: Column, base: Column) -> Column:
    """A link of a page as an absolute http or https URL: absolute links as they are, others from the page's scheme and
    host or folder; null for other schemes and for links within the page."""
    folder = F.regexp_extract(part(base, 3), r"^(.*/)", 1)
    home = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    other = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (F.trim(link) == "") | link.startswith("#")
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(other, F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(home, link))
        .otherwise(F.concat(home, F.when(folder == "", "/").otherwise(folder), link))
    )


def media_key(url: Column) -> Column:
    """Identity of a media URL: parameters that sign or expire are dropped, the others sorted, resize paths folded, http
    and https alike."""
    path = F.regexp_replace(part(url, 3), r"/(resize|fit-in|thumb(nails?|s)?|crop)/\d+x\d+/", "/")
    return F.when(url.rlike(_SHAPE), F.concat(F.lit("https://"), F.lower(part(url, 2)), F.when(path == "", "/").otherwise(path), parameters(url, SIGNATURES, True, True))).otherwise(url)


def history_key(url: Column) -> Column:
    """Origin and path with everything but letters and digits as ``_``, in lower case."""
    base = F.when(url.rlike(_SHAPE), F.concat(part(url, 1), F.lit("://"), part(url, 2), F.when(part(url, 3) == "", "/").otherwise(part(url, 3)))).otherwise(F.coalesce(url, F.lit("")))
    return F.lower(F.regexp_replace(base, "[^A-Za-z0-9]", "_"))


def site(url: Column) -> Column:
    """The registrable domain: the last two labels of the host, three where the last two are a country's suffix."""
    host = F.lower(F.regexp_replace(part(url, 2), r"(^.*@|:\d+$)", ""))
    return F.coalesce(F.nullif(F.regexp_extract(host, rf"([^.]+\.(?:{TWO_PART})\.[a-z]{{2}})$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def safe_name(name: Column, fallback: str = "file") -> Column:
    """A name that any file system takes: forbidden characters as ``_``, no trailing dots or blanks, no device names."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")
    clean = F.regexp_replace(F.trim(clean), r"[. ]+$", "")
    return F.when(clean == "", F.lit(fallback)).when(clean.rlike(r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|$)"), F.concat(F.lit("_"), clean)).otherwise(clean)


def redact_queries(text: Column) -> Column:
    """Query strings of URLs in a text, as ``?…``."""
    return F.regexp_replace(text, r"(https?://[^\s?#]+)\?[^\s#]*", "$1?…")


# Addresses of private networks, paths that are for reading, parameters that carry credentials.
PRIVATE_HOST = r"[\[\]:]|^[\d.]+$|(?:^|\.)(?:localhost|local|internal|onion|reddit\.com|redd\.it)$"
NO_READING = r"(?i)\.(?:json|rss|xml)$|/(?:submit|compose|modmail)(?:/|$)"
READING = r"(?i)^/$|^/(?:r|u|user|comments|duplicates|search|wiki|w)(?:/|$)|^/(?:best|hot|new|top|rising|controversial)/?$"
CREDENTIALS = r"(?i)[?&](?:access_token|refresh_token|id_token|token|code|state|password)(?:=|&|$)"
FRAGMENT_CREDENTIALS = r"(?i)[&#](?:access_token|refresh_token|id_token)="


def public_origin(url: Column) -> Column:
    """``https://host`` of an https URL without credentials, port, query or fragment, at the root, on a public host; else
    null. White space around it does not count; over 255 characters are none."""
    bare = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    host = F.regexp_replace(F.lower(part(bare, 2)), r":(?:443)?$", "")
    plain = (F.char_length(url) <= 255) & (F.lower(part(bare, 1)) == "https") & part(bare, 3).isin("", "/") & part(bare, 4).isin("", "?") & part(bare, 5).isin("", "#") & ~host.contains("@")
    return F.when(plain & host.contains(".") & ~host.rlike(PRIVATE_HOST), F.concat(F.lit("https://"), host))


def trimmed_path(path: Column) -> Column:
    """A path without closing slashes; the root stays."""
    return F.coalesce(F.nullif(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), F.lit("")), F.lit("/"))


def is_reading_path(path: Column) -> Column:
    return ~path.rlike(NO_READING) & path.rlike(READING)


def reading_url(url: Column, sites: str = r"^(?:(?:www|old|new|np|m|sh)\.)?reddit\.com$", short: str = r"^(?:www\.)?redd\.it$") -> Column:
    """Path, query and fragment of a link to read on a mirror: known hosts only, short and gallery links as their comments,
    nothing that carries credentials; else null."""
    host, path = F.lower(part(url, 2)), F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    brief = host.rlike(short)
    known = F.lower(part(url, 1)).isin("http", "https") & (host.rlike(sites) | (brief & path.rlike("(?i)^/[a-z0-9]+/?$")))
    path = F.when(brief, F.concat(F.lit("/comments/"), F.regexp_extract(path, "^/([^/]*)", 1))).otherwise(path)
    path = F.regexp_replace(path, "(?i)^/gallery/([a-z0-9]+)/?$", "/comments/$1")
    safe = ~part(url, 4).rlike(CREDENTIALS) & ~part(url, 5).rlike(FRAGMENT_CREDENTIALS)
    return F.when(known & safe & is_reading_path(path), F.concat(trimmed_path(path), part(url, 4), part(url, 5)))


def location_of(location: Column, folder: Column) -> Column:
    """Where a playlist entry lies: URLs and absolute paths as they are, others below the playlist's folder; ``.`` is
    dropped and ``..`` goes up."""
    own = F.regexp_replace(location, r"\\", "/")
    absolute = own.rlike(r"^([A-Za-z]:/|/)")
    joined = F.when(absolute, own).otherwise(F.concat_ws("/", F.regexp_replace(folder, r"[/\\]+$", ""), own))
    steps = F.filter(F.split(joined, "/"), lambda s: s != ".")
    up = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when((s == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.when(location.rlike("^[A-Za-z][A-Za-z0-9+.-]+://"), location).otherwise(F.array_join(up, "/"))


def plain_file_name(name: Column) -> Column:
    """A name for any file system: control and forbidden characters as ``_``, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r'[\x00-\x1f<>:"/\\|?*]', "_"))


def name_from_url(url: Column, extension: str = "jpg") -> Column:
    """The last segment of a URL's path; with a default extension where it has none, and a default name where it is empty."""
    last = F.regexp_extract(part(url, 3), r"([^/]*)/?$", 1)
    named = F.when(last == "", "file").otherwise(last)
    return F.when(named.rlike(r"\.[A-Za-z0-9]{1,5}$"), named).otherwise(F.concat(named, F.lit(f".{extension}")))


def with_extension(name: Column, wanted: Column) -> Column:
    """The name with another extension in place of its own; as it is where none is wanted."""
    return F.when(wanted.isNull(), name).otherwise(F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit("."), wanted))


def group_key(parent: Column, tab: Column, frame: Column, element: Column, key: Column) -> Column:
    """What a found file belongs to: its manifest, else the page element that shows it, else its own address."""
    at = F.when(element.isNotNull(), F.concat_ws(":", F.lit("el"), tab.cast("string"), frame.cast("string"), element))
    return F.coalesce(F.concat(F.lit("parent:"), parent), at, F.concat(F.lit("url:"), key))


def text_hash(text: Column) -> Column:
    """A 32-bit hash that multiplies by 31 and adds each code unit, its absolute value in base 36."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(digits) / 4).cast("int")
    units = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")))
    wrap = lambda x: F.pmod(x + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    value = F.aggregate(units, F.lit(0).cast("bigint"), lambda a, c: wrap(a * 31 + c))
    return F.lower(F.conv(F.abs(value).cast("string"), 10, 36))
