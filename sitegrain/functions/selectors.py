"""CSS selectors over a scanned page.

Supported: tag, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]``, ``[a*=v]``, ``[a^=v]``,
``[a$=v]``, ``[a~=v]``, descendant and child combinators, comma lists.
"""

from __future__ import annotations

import re
from functools import lru_cache

from sitegrain.functions.html import LAST, NAME, PARENT, Page

_SIMPLE = re.compile(
    r"""\#(?P<id>[\w-]+)
      | \.(?P<cls>[\w-]+)
      | \[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]
      | (?P<tag>[A-Za-z][\w-]*|\*)""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*(>|\s|,|\Z)\s*")

_TESTS = {
    "=": lambda have, want: have == want,
    "*=": lambda have, want: bool(want) and want in have,
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "~=": lambda have, want: want in have.split(),
    None: lambda have, want: True,
}


@lru_cache(maxsize=1024)
def compile_selector(selector: str) -> tuple:
    """Parse a selector into alternatives of ``(combinator, tag, tests)`` steps, last step first."""
    alternatives, steps, joiner, at = [], [], " ", 0
    selector = selector.strip()
    while True:
        tag, tests, begin = None, [], at
        while match := _SIMPLE.match(selector, at):
            part = match.groupdict()
            if part["tag"]:
                if at != begin:
                    raise ValueError(f"misplaced tag name in selector {selector!r}")
                tag = None if part["tag"] == "*" else part["tag"].lower()
            elif part["id"]:
                tests.append(("id", "=", part["id"]))
            elif part["cls"]:
                tests.append(("class", "~=", part["cls"]))
            else:
                value = next((part[k] for k in ("dq", "sq", "bare") if part[k] is not None), None)
                tests.append((part["attr"].lower(), part["op"], value))
            at = match.end()
        end = _COMBINATOR.match(selector, at)
        if at == begin or end is None:
            raise ValueError(f"unsupported selector {selector!r}")
        steps.append((joiner, tag, tuple(tests)))
        at = end.end()
        joiner = end.group(1) if end.group(1) == ">" else " "
        if end.group(1) in (",", ""):
            alternatives.append(tuple(reversed(steps)))
            steps, joiner = [], " "
            if end.group(1) == "":
                return tuple(alternatives)


def _matches(page: Page, node: int, steps: tuple, index: int = 0) -> bool:
    joiner, tag, tests = steps[index]
    if tag is not None and page.nodes[node][NAME] != tag:
        return False
    if tests:
        attributes = page.attributes(node)
        for name, op, want in tests:
            have = attributes.get(name)
            if have is None or not _TESTS[op](have, want):
                return False
    if index + 1 == len(steps):
        return True
    parent = page.nodes[node][PARENT]
    while parent >= 0:
        if _matches(page, parent, steps, index + 1):
            return True
        if joiner == ">":
            return False
        parent = page.nodes[parent][PARENT]
    return False


def select(page: Page, selector: str, within: int | None = None) -> list[int]:
    """Matching elements in document order; with ``within``, only its descendants."""
    alternatives = compile_selector(selector)
    first, last = (0, len(page.nodes)) if within is None else (within + 1, page.nodes[within][LAST])
    wanted = {steps[0][1] for steps in alternatives}
    return [
        node
        for node in range(first, last)
        if (None in wanted or page.nodes[node][NAME] in wanted)
        and any(_matches(page, node, steps) for steps in alternatives)
    ]
