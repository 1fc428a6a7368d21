"""URL work: row helpers for Arrow UDFs, and Column expressions where Spark has the parts.

Paths are compared and rendered as bytes, so escapes that are not UTF-8 survive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import quote, quote_plus, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space by the Unicode property, as trimmed around hrefs and text lines.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
DEFAULT_PORTS = {"http": "80", "https": "443"}
TRACKING_PREFIX = "utm_"

# What may stand in each URL part (RFC 3986, plus the characters lenient parsers take in hosts).
_USER_CLASS = r"[A-Za-z0-9._~!$&'()*+,;=:@%-]"
_HOST_CLASS = r"""[A-Za-z0-9._~!$&'()*+,;=<>"-]"""
_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"

_SPLIT = re.compile(
    rf"(?:({_SCHEME}):)?(?:(?<=:)//([^/?#]*)|//(?!/)([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?", re.S
)
_AUTHORITY = re.compile(
    rf"""(?:({_USER_CLASS}*)@)?(\[[^\[\]@/?#\s]*\]|(?:{_HOST_CLASS}|[^\x00-\x7f]|%[89A-Fa-f][0-9A-Fa-f])*)(?::([0-9]*))?""",
)
_ABSOLUTE = re.compile(f"{_SCHEME}:")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_BAD = re.compile(_BAD_ESCAPE)
_PLAIN_PATH = re.compile(r"[A-Za-z0-9._~!$&'()*+,;=:@/\[\]%-]*")
_PLAIN_FRAGMENT = re.compile(r"[A-Za-z0-9._~!$&'()*+,;=:@/?\[\]%-]*")
_PATH_SAFE = "$&+,/:;=@"
_FRAGMENT_SAFE = "$&+,/:;=?@!()*"
_PLAIN_REST = r"(?:/[A-Za-z0-9_~,-][A-Za-z0-9._~,-]*)+/?(?:\?[^#\x00-\x1f\x7f]*)?"
_ROOTED = re.compile(_PLAIN_REST)
_OTHER_HOST = re.compile(r"//[A-Za-z0-9.-]+" + _PLAIN_REST)
_UPWARD = re.compile(r"\.\." + _PLAIN_REST)
_PLAIN_BASE = re.compile(r"(https?)(://[A-Za-z0-9.-]+)(/[A-Za-z0-9._~,/-]*)?")


class Url(NamedTuple):
    scheme: str
    user: str | None
    host: str
    port: str | None
    has_authority: bool
    path: str
    query: str | None
    fragment: str
    opaque: bool


def split_url(text: str) -> Url | None:
    """Split a URL reference; None when it is not one."""
    scheme, with_scheme, without, path, query, fragment = _SPLIT.fullmatch(text).groups()
    authority = with_scheme if with_scheme is not None else without
    if _CONTROL.search(text.partition("#")[0]) or _BAD.search(path) or _BAD.search(fragment or ""):
        return None
    if scheme is None and authority is None and ":" in path.partition("/")[0]:
        return None
    user = port = None
    host = ""
    if authority is not None:
        parts = _AUTHORITY.fullmatch(authority)
        if parts is None or _BAD.search(parts[1] or ""):
            return None
        user, host, port = parts.groups()
    opaque = scheme is not None and authority is None and not path.startswith("/") and path != ""
    return Url((scheme or "").lower(), user, host, port, authority is not None, path, query, fragment or "", opaque)


# Rows of one page follow each other, so their base is split once.
_split_base = lru_cache(maxsize=1024)(split_url)


def _render(raw: str, plain: re.Pattern, safe: str) -> str:
    return raw if plain.fullmatch(raw) else quote(unquote_to_bytes(raw), safe=safe)


def _path(raw: str) -> str:
    return _render(raw, _PLAIN_PATH, _PATH_SAFE)


def _remove_dots(path: str) -> str:
    if "." not in path:
        return path if path.startswith("/") or not path else "/" + path
    kept: list[str] = []
    segments = path.removeprefix("/").split("/")
    for segment in segments:
        if segment == "..":
            del kept[-1:]
        elif segment != ".":
            kept.append(segment)
    if segments[-1] in (".", ".."):
        kept.append("")
    return "/" + "/".join(kept)


def join(base: Url, ref: Url) -> Url:
    """Resolve a reference against a base URL (RFC 3986 section 5); paths come out rendered."""
    if ref.opaque:
        return ref
    if ref.scheme or ref.has_authority and (ref.host or ref.user is not None):
        return ref._replace(scheme=ref.scheme or base.scheme, path=_remove_dots(_path(ref.path)))
    query, fragment = ref.query, ref.fragment
    if not ref.path and query is None:
        query, fragment = base.query or None, fragment or base.fragment
        if base.opaque:
            return base._replace(query=query, fragment=fragment)
    path = _path(ref.path)
    if not path:
        path = _path(base.path)
    elif not path.startswith("/"):
        path = _path(base.path).rpartition("/")[0] + "/" + path
    return base._replace(path=_remove_dots(path), query=query, fragment=fragment, opaque=False)


def _authority(user: str | None, host: str, port: str | None) -> str:
    if not host.isascii():
        host = quote(host, safe="".join(chr(c) for c in range(33, 127)))
    return ("" if user is None else user + "@") + host + ("" if port is None else ":" + port)


def to_text(url: Url) -> str:
    if url.opaque:
        head = url.scheme + ":" + url.path
    else:
        authority = _authority(url.user, url.host, url.port)
        path = url.path
        if authority and path and not path.startswith("/"):
            path = "/" + path
        head = url.scheme + ":" if url.scheme else ""
        head += ("//" + authority if authority or url.scheme and path else "") + path
    if url.query is not None:
        head += "?" + url.query
    return head + ("#" + _render(url.fragment, _PLAIN_FRAGMENT, _FRAGMENT_SAFE) if url.fragment else "")


@lru_cache(maxsize=1024)
def _origin(base: str) -> str | None:
    url = _split_base(base)
    if url is None or url.opaque or not url.scheme or not url.host:
        return None
    return f"{url.scheme}://{_authority(url.user, url.host, url.port)}"


@lru_cache(maxsize=1024)
def _above(base: str) -> str | None:
    """What ``..`` stands for on a page, without the slash behind it; None when the page is no URL."""
    parent = _split_base(base)
    return None if parent is None else to_text(join(parent, split_url("../")))[:-1]


def resolve(base: str, href: str) -> str:
    """Absolute form of ``href`` on page ``base``; absolute and unparseable hrefs come back as they are."""
    # Most links need nothing normalised or encoded in the path, and most pages' parts are seen at once: small pages are many, so
    # their bases are not worth a place in a cache.
    start = href[:2]
    if start == "//":
        if _OTHER_HOST.fullmatch(href):
            plain = _PLAIN_BASE.fullmatch(base)
            if plain is not None:
                return f"{plain[1]}:{href}"
    elif start[:1] == "/":
        if _ROOTED.fullmatch(href):
            plain = _PLAIN_BASE.fullmatch(base)
            origin = _origin(base) if plain is None else plain[1] + plain[2]
            if origin is not None:
                return origin + href
    elif start == "..":
        if _UPWARD.fullmatch(href):
            plain = _PLAIN_BASE.fullmatch(base)
            folder = None if plain is None else (plain[3] or "").rpartition("/")[0]
            if folder is None or "." in folder:
                above = _above(base)
                return href if above is None else above + href[2:]
            return f"{plain[1]}{plain[2]}{folder.rpartition('/')[0]}{href[2:]}"
    elif _ABSOLUTE.match(href):
        return href
    parent, ref = _split_base(base), split_url(href)
    return href if parent is None or ref is None else to_text(join(parent, ref))


def _clean(path: bytes) -> bytes:
    kept: list[bytes] = []
    for segment in path.split(b"/"):
        if segment == b"..":
            del kept[-1:]
        elif segment not in (b"", b"."):
            kept.append(segment)
    return b"/" + b"/".join(kept)


def _encode_query(query: str, dropped: frozenset[str]) -> str:
    pairs = []
    for pair in query.split("&"):
        key, _, value = pair.partition("=")
        if not pair or ";" in pair or _BAD.search(pair):
            continue
        key, value = (unquote_to_bytes(part.replace("+", " ")) for part in (key, value))
        name = key.decode("utf-8", "replace").lower()
        if not name.startswith(TRACKING_PREFIX) and name not in dropped:
            pairs.append((key, value))
    pairs.sort(key=lambda pair: pair[0])
    return "&".join(f"{quote_plus(key, safe='')}={quote_plus(value, safe='')}" for key, value in pairs)


def ignored_names(ignore_params: Iterable[str]) -> frozenset[str]:
    return frozenset(name for name in (param.lower().strip(SPACE) for param in ignore_params) if name)


def canonicalize(base: str, href: str, dropped: frozenset[str], root_prefixes: Sequence[str]) -> str | None:
    """Canonical URL of ``href`` on page ``base``; None when either does not parse."""
    href = href.strip(SPACE)
    if href and not href.startswith(("/", "./", "../")):
        prefixes = tuple(prefix for prefix in (p.strip(SPACE) for p in root_prefixes) if prefix)
        if prefixes and href.startswith(prefixes):
            href = "/" + href
    parent, ref = _split_base(base), split_url(href)
    if parent is None or ref is None:
        return None
    url = join(parent, ref)
    query = _encode_query(url.query or "", dropped) or None
    if url.opaque:
        return to_text(url._replace(query=query, fragment=""))
    port = url.port or None
    if DEFAULT_PORTS.get(url.scheme) == port:
        port = None
    decoded = unquote_to_bytes(url.path)
    cleaned = _clean(decoded)
    path = url.path if cleaned == decoded else quote(cleaned, safe=_PATH_SAFE)
    return to_text(url._replace(host=url.host.lower(), port=port, path=path, query=query, fragment=""))


# Column expressions

_BEFORE_HOST = rf"^(?:{_SCHEME}:)?//(?:{_USER_CLASS}*@)?\[?"
_AFTER_HOST = r"\]?(?::[0-9]*)?(?=[/?#]|\z)"
_HOST = rf"(?<=\[)[^\[\]@/?#\s]*(?=\])|{_HOST_CLASS[:-2]}%\x{{80}}-\x{{10FFFF}}-]*"
_SUSPECT = r"[\x00-\x1f\x7f%]"
_NOT_A_URL = (
    rf"^[^#]*[\x00-\x1f\x7f]|^[^?#]*{_BAD_ESCAPE}|#(?s:.)*{_BAD_ESCAPE}"
    rf"|^(?:{_SCHEME}:)?//(?:[^/?#]*@)?[^/?#@]*%(?![89A-Fa-f])"
)


def _parses(url: Column) -> Column:
    """False for URLs with control characters or bad escapes; few need the full pattern."""
    return ~(url.rlike(_SUSPECT) & url.rlike(_NOT_A_URL))


def url_host(url: Column) -> Column:
    """Host without port or user; empty when the URL has none or does not parse."""
    return F.when(_parses(url), F.regexp_extract(url, f"{_BEFORE_HOST}({_HOST}){_AFTER_HOST}", 1)).otherwise("")


def on_domain(url: Column, domains: Iterable[str]) -> Column:
    """True where the URL's host equals a domain or lies under it; case matters."""
    names = "|".join(rf"\Q{domain}\E" for domain in domains)
    if not names:
        return F.lit(False)
    under = rf"(?:{_HOST_CLASS[:-2]}%\x{{80}}-\x{{10FFFF}}-]*\.)?(?:{names})"
    return F.coalesce(url.rlike(_BEFORE_HOST + under + _AFTER_HOST) & _parses(url), F.lit(False))


def _form_encode(text: Column) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def _by_escape(text: Column, plain, escape) -> Column:
    """The parts of form-encoded text joined: ``plain`` of text without escapes, ``escape`` of an escape's two digits."""

    def part(value: Column, i: Column) -> Column:
        byte, after = F.upper(F.substr(value, F.lit(1), F.lit(2))), F.substr(value, F.lit(3))
        return F.when(i == 0, plain(value)).otherwise(F.concat(escape(byte), plain(after)))

    spaced = F.replace(text, F.lit("+"), F.lit(" "))
    return F.when(F.contains(spaced, F.lit("%")), F.array_join(F.transform(F.split(spaced, "%"), part), "")).otherwise(plain(spaced))


def _form_hex(text: Column) -> Column:
    """Hexadecimal digits of the bytes that form-encoded text stands for, whether they are UTF-8 or not; they sort as the bytes do."""
    return _by_escape(text, F.hex, lambda byte: byte)


def _form_again(text: Column) -> Column:
    """Form-encoded text, encoded again: bytes that need no escape lose it, and digits are upper case."""

    def escape(byte: Column) -> Column:
        code = F.conv(byte, 16, 10).cast("int")
        return F.when(code < 128, _form_encode(F.char(code))).otherwise(F.concat(F.lit("%"), byte))

    return _by_escape(text, _form_encode, escape)


def strip_tracking_params(query: Column, ignore_params: Iterable[str] = ()) -> Column:
    """Query string without tracking and ignored keys, sorted by key and encoded again, byte by byte."""
    dropped = sorted(ignored_names(ignore_params))

    def usable(text: Column) -> Column:
        return (text != "") & ~F.contains(text, F.lit(";")) & ~text.rlike(_BAD_ESCAPE)

    def kept(pair: Column) -> Column:
        name = F.lower(F.make_valid_utf8(F.unhex(pair["key"]).cast("string")))
        return ~F.startswith(name, F.lit(TRACKING_PREFIX)) & ~name.isin(dropped)

    def by_key(left: Column, right: Column) -> Column:
        return F.when(left["key"] < right["key"], -1).when(left["key"] > right["key"], 1).otherwise(0)

    def parts(text: Column) -> Column:
        at = F.instr(text, "=")
        key = F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)
        value = F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))
        return F.struct(_form_hex(key).alias("key"), F.concat(_form_again(key), F.lit("="), _form_again(value)).alias("text"))

    pairs = F.transform(F.filter(F.split(query, "&"), usable), parts)
    pairs = F.array_sort(F.filter(pairs, kept), by_key)
    return F.array_join(F.transform(pairs, lambda p: p["text"]), "&")


def query_of(url: Column) -> Column:
    """Raw query string of a URL, empty when it has none."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
