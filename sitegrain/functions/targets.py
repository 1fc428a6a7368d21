"""Links of a page, resolved: in one pass over plain markup, by the full rules of ``html`` and ``urls`` otherwise."""

from __future__ import annotations

import re

from sitegrain.functions import html, urls

# Links with nothing to decode, normalise or encode, and tags that hold neither link nor raw text.
_PATH = r"(?:/[A-Za-z0-9_~,-][A-Za-z0-9._~,-]*+)++/?"
_REST = rf"{_PATH}(?:\?[A-Za-z0-9._~:/?@!$()*+,;=%-]*+)?"
_ABSOLUTE = r"[A-Za-z][A-Za-z0-9+.-]*+:[A-Za-z0-9._~:/?@!$()*+,;=%-]*+"
_RAW_NAMES = "|".join(sorted(html.RAW_TEXT | html.ESCAPABLE_RAW_TEXT))
_PLAIN_TAG = re.compile(
    rf"""<(?:[aA][ ]href=(["']?)(?:({_REST})|//([A-Za-z0-9.-]++{_REST})|\.\.({_REST})|({_ABSOLUTE}))\1>
      | /[A-Za-z][A-Za-z0-9]*+>
      | (?!(?i:{_RAW_NAMES}))[A-Za-z][A-Za-z0-9]*+>
      | (.*+))  # other markup, and all behind it""",
    re.S | re.X,
)
_PLAIN_BASE = re.compile(r"(https?)(://[A-Za-z0-9.-]++)((?:/[A-Za-z0-9_~,-]*+)*+)")


def page_targets(base: str, page: str) -> list[str]:
    """Distinct links of ``page`` in document order, each as ``urls.resolve`` gives it on ``base``."""
    plain = None if "\r" in page else _PLAIN_BASE.fullmatch(base)
    if plain is not None:
        scheme, host, path = plain.groups()
        found = []
        for _, rooted, other, upward, absolute, markup in _PLAIN_TAG.findall(page):
            if rooted:
                found.append(f"{scheme}{host}{rooted}")
            elif absolute:
                found.append(absolute)
            elif other:
                found.append(f"{scheme}://{other}")
            elif upward:
                found.append(f"{scheme}{host}{path.rpartition('/')[0].rpartition('/')[0]}{upward}")
            elif markup:
                break
        else:
            return list(dict.fromkeys(found))
    return list(dict.fromkeys([urls.resolve(base, href) for href in html.hrefs(page)]))
