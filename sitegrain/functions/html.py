"""One-pass HTML scan used inside Arrow UDFs.

Spark has no HTML function, so this small helper runs per page inside the tasks.
``tags`` walks the markup; ``scan`` adds just enough of the HTML standard's tree
rules (implied end tags, misnested formatting, raw-text elements) to give every
element a parent and a slice of the page text.

Left out, and harmless for the operators here: moving stray table content before
its table, and repeating unclosed formatting elements in the next block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.entities import html5

# Element classes named by the HTML standard.
VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes noscript plaintext script style xmp".split())
ESCAPABLE_RAW_TEXT = frozenset("textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_CONTENT = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
CLOSES_PARAGRAPH = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure"
    " footer form header hgroup hr li listing main menu nav ol p plaintext pre search section summary"
    " table ul xmp".split()
)
SPECIAL = CLOSES_PARAGRAPH | VOID | RAW_TEXT | ESCAPABLE_RAW_TEXT | frozenset(
    "applet body button caption colgroup frameset head html marquee object select tbody td template"
    " tfoot th thead tr".split()
)
SCOPE = frozenset("applet caption html marquee object table td template th".split())
TABLE_SCOPE = frozenset("html table template".split())
TABLE_PARTS = frozenset("caption colgroup tbody td tfoot th thead tr table".split())
# A new table part first closes everything up to one of these.
TABLE_CONTEXT = {
    "td": frozenset("tr tbody tfoot thead".split()) | TABLE_SCOPE,
    "th": frozenset("tr tbody tfoot thead".split()) | TABLE_SCOPE,
    "tr": frozenset("tbody tfoot thead".split()) | TABLE_SCOPE,
    **{part: TABLE_SCOPE for part in "caption colgroup tbody tfoot thead".split()},
}

# How far up an open paragraph, an open list item, or the item an end tag closes is looked for.
_PARAGRAPH_BARRIER = SCOPE | {"button"}
_LIST_BARRIER = (SPECIAL - {"address", "div", "p"}) | SCOPE
_ITEM_BARRIER = SCOPE | {"ol", "ul"}
_OUTER = frozenset(("html", "head", "body"))
_CLOSES_ALIKE = HEADINGS | TABLE_CONTEXT.keys() | {"a", "button", "dd", "dt", "li", "optgroup", "option"}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
      | <(/?)([A-Za-z][^ \t\n\f/>]*+)
         ((?:[^>=]++|=[ \t\n\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\f>"'][^ \t\n\f>]*+)?+)*+)>
      | <[!?/](?![A-Za-z])[^>]*+>?
      | <![A-Za-z\[][^>]*+>?
      | </?[A-Za-z].*+""",
    re.S | re.X,
)
_ATTRIBUTE = re.compile(
    r"""([^ \t\n\f/=][^ \t\n\f/=]*)(?:[ \t\n\f]*=[ \t\n\f]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f]*)))?"""
)
_ATTRIBUTE_REFERENCE = re.compile(r"&(#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[0-9A-Za-z]++(?:;|(?!=)))")
_RAW_END = {
    name: re.compile(rf"</{name}(?=[ \t\n\f/>])", re.I) for name in RAW_TEXT | ESCAPABLE_RAW_TEXT if name != "plaintext"
}


def _reference(match: re.Match) -> str:
    name = match.group(1)
    return unescape(match.group()) if name[0] == "#" else html5.get(name, match.group())


def _attribute_text(value: str) -> str:
    """Decode character references by the rule for attributes: ``&copy=1`` stays as it is."""
    return _ATTRIBUTE_REFERENCE.sub(_reference, value) if "&" in value else value


def attributes(source: str) -> dict[str, str]:
    """Attributes of a start tag; the first of several with one name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _attribute_text(double or single or bare))
    return found


def tags(page: str, text: bool = True) -> Iterator[tuple[str, str, str]]:
    """Yield ``(kind, name, data)``: text (``"#"``), start tags (``""``) and end tags (``"/"``).

    Text is as written; ``name`` then tells the raw-text element it stands in, if any.
    Without ``text`` only tags are yielded.
    """
    if "\r" in page:
        page = page.replace("\r\n", "\n").replace("\r", "\n")
    start, at, size = 0, 0, len(page)
    while True:
        at = page.find("<", at)
        match = _TOKEN.match(page, at) if at >= 0 else None
        if at >= 0 and match is None:
            at += 1  # a lone "<" is text
            continue
        stop = at if match else size
        if text and stop > start:
            yield "#", "", page[start:stop]
        if match is None:
            return
        start = at = match.end()
        closing, name, data = match.groups()
        if name is None:
            continue
        name = name.lower()
        yield closing, name, data
        if not closing and (name in RAW_TEXT or name in ESCAPABLE_RAW_TEXT):
            end = _RAW_END[name].search(page, at) if name in _RAW_END else None
            start = at = end.start() if end else size
            if text and at > match.end():
                yield "#", name, page[match.end() : at]


_RAW_START = re.compile(rf"<(?:{'|'.join(sorted(_RAW_END))}|plaintext)", re.I)


def hrefs(page: str) -> list[str]:
    """``href`` of every ``a[href]`` in document order, repeats and empty values included."""
    found = []
    # Without raw text, every token is markup, and the pattern finds them all in one go.
    every = tags(page, text=False) if "\r" in page or _RAW_START.search(page) else _TOKEN.findall(page)
    for kind, name, data in every:
        if (name == "a" or name == "A") and not kind:
            href = attributes(data).get("href")
            if href is not None:
                found.append(href)
    return found


NAME, SOURCE, PARENT, BEGIN, END, LAST = range(6)


class Page:
    """Elements in document order, each with its parent and its ``[begin, end)`` slice of ``text``.

    A node is ``[name, attribute source, parent index, begin, end, index after its last descendant]``.
    """

    __slots__ = ("text", "nodes", "_attributes")

    def __init__(self) -> None:
        self.text = ""
        self.nodes: list[list] = []
        self._attributes: dict[int, dict[str, str]] = {}

    def attributes(self, node: int) -> dict[str, str]:
        found = self._attributes.get(node)
        if found is None:
            found = self._attributes[node] = attributes(self.nodes[node][SOURCE])
        return found

    def text_of(self, node: int) -> str:
        return self.text[self.nodes[node][BEGIN] : self.nodes[node][END]]

    def text_without(self, removed: frozenset[str]) -> str:
        """Page text without the subtrees of the named elements."""
        kept, at = [], 0
        for node in self.nodes:
            if node[NAME] in removed and node[END] > at:
                kept.append(self.text[at : max(at, node[BEGIN])])
                at = node[END]
        kept.append(self.text[at:])
        return "".join(kept)


def scan(page: str) -> Page:
    """Build the element table of one page."""
    out = Page()
    nodes, stack, pieces = out.nodes, [], []
    places: list[int] = []  # index of each open element
    opened: defaultdict[str, int] = defaultdict(int)  # open elements by name, so most lookups need no walk
    length = 0

    def shut(node: list) -> None:
        opened[node[NAME]] -= 1
        node[END] = length
        node[LAST] = len(nodes)

    def close(depth: int) -> None:
        for node in stack[depth:]:
            shut(node)
        del stack[depth:], places[depth:]

    def open_(name: str, source: str) -> None:
        node = [name, source, places[-1] if places else -1, length, length, len(nodes) + 1]
        if name not in VOID:
            opened[name] += 1
            stack.append(node)
            places.append(len(nodes))
        nodes.append(node)

    def find(wanted, barrier) -> int:
        """Stack index of the nearest open element in ``wanted``, not looking past ``barrier``."""
        for name in wanted:
            if opened[name]:
                break
        else:
            return -1
        for depth in range(len(stack) - 1, -1, -1):
            name = stack[depth][NAME]
            if name in wanted:
                return depth
            if name in barrier:
                return -1
        return -1

    def close_nearest(wanted, barrier) -> None:
        depth = find(wanted, barrier)
        if depth >= 0:
            close(depth)

    def end_formatting(name: str) -> None:
        depth = find((name,), SCOPE)
        if depth < 0:
            return
        if any(node[NAME] in SPECIAL for node in stack[depth + 1 :]):
            shut(stack.pop(depth))  # the blocks opened inside stay open
            del places[depth]
        else:
            close(depth)

    def enter_body(source: str = "") -> None:
        nonlocal in_body
        in_body = True
        close(1)
        open_("body", source)

    open_("html", "")
    in_body = False
    skip_newline = False

    for kind, name, data in tags(page):
        if kind == "#":
            if skip_newline:
                skip_newline = False
                data = data.removeprefix("\n")
            if "&" in data and name not in RAW_TEXT:
                data = unescape(data)
            if "\0" in data:
                data = data.replace("\0", "")
            if not in_body and not name and data.strip(" \t\n\f"):
                enter_body()
            pieces.append(data)
            length += len(data)
            continue
        skip_newline = False
        if not kind:
            if name in _OUTER:
                if name == "html":
                    nodes[0][SOURCE] = nodes[0][SOURCE] or data
                elif name == "body" and not in_body:
                    enter_body(data)
                elif name == "head" and not in_body and len(stack) == 1:
                    open_(name, data)
                continue
            if not in_body and not opened["template"]:
                if name not in HEAD_CONTENT:
                    enter_body()
                elif not any(node[NAME] == "head" for node in nodes):
                    open_("head", "")
            if opened["p"] and name in CLOSES_PARAGRAPH:
                close_nearest(("p",), _PARAGRAPH_BARRIER)
            if name in _CLOSES_ALIKE:
                if name == "li":
                    close_nearest(("li",), _LIST_BARRIER)
                elif name in ("dd", "dt"):
                    close_nearest(("dd", "dt"), _LIST_BARRIER)
                elif name in HEADINGS:
                    if stack[-1][NAME] in HEADINGS:
                        close(len(stack) - 1)
                elif name == "a":
                    end_formatting("a")
                elif name == "button":
                    close_nearest(("button",), SCOPE)
                elif name in ("option", "optgroup"):
                    if stack[-1][NAME] == "option":
                        close(len(stack) - 1)
                elif find(("table",), ("template",)) >= 0:
                    close(find(TABLE_CONTEXT[name], ()) + 1)
            foreign = data.endswith("/") and (opened["svg"] or opened["math"])
            open_(name, data)
            if foreign and name not in VOID:
                close(len(stack) - 1)
            skip_newline = name in ("listing", "pre", "textarea")
        elif name == "html" or name == "body":
            continue
        elif stack[-1][NAME] == name:  # most end tags close the innermost element
            shut(stack.pop())
            places.pop()
        elif name in VOID:
            continue
        elif name == "head":
            if not in_body:
                close(1)
        elif name in FORMATTING:
            end_formatting(name)
        elif name in HEADINGS:
            close_nearest(HEADINGS, SCOPE)
        elif name in TABLE_PARTS:
            close_nearest((name,), TABLE_SCOPE)
        elif name == "p":
            close_nearest(("p",), _PARAGRAPH_BARRIER)
        elif name == "li":
            close_nearest(("li",), _ITEM_BARRIER)
        elif name in SPECIAL:
            close_nearest((name,), SCOPE)
        else:
            close_nearest((name,), SPECIAL)
    close(0)
    out.text = "".join(pieces)
    return out
