"""Strict decoding of the JSON block in a model response."""

from __future__ import annotations

import json

from sitegrain.functions.urls import SPACE

# Record field for each JSON name.
TEXT_FIELDS = ("job_title", "company_name", "location", "salary_range", "description", "links")
LIST_FIELD = "required_skills"


class _Mismatch(ValueError):
    pass


def _no_constant(name: str):
    raise _Mismatch(name)


def _printable(text: str) -> str:
    """Replace lone surrogates, which JSON escapes can spell but UTF-8 cannot hold."""
    if text.isascii():
        return text
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _text(value) -> str:
    if not isinstance(value, str):
        raise _Mismatch("not a string")
    return _printable(value)


def _record(pairs) -> dict:
    record: dict = dict.fromkeys(TEXT_FIELDS, "")
    record[LIST_FIELD] = []
    if pairs is None:
        return record
    if not isinstance(pairs, _Object):
        raise _Mismatch("not an object")
    for key, value in pairs:
        name = key.casefold()
        if name == LIST_FIELD:
            if value is not None and (isinstance(value, _Object) or not isinstance(value, list)):
                raise _Mismatch("not an array")
            record[name] = ["" if item is None else _text(item) for item in value or ()]
        elif name in record and value is not None:
            record[name] = _text(value)
    return record


class _Object(list):
    """Key and value pairs in source order, so that a repeated key acts in turn."""


def decode_records(block: str) -> tuple[str, list[dict]]:
    """Return ``(status, records)`` for a block; any value off its type fails the whole block."""
    block = block.strip(SPACE)
    if not block:
        return "empty", []
    try:
        items = json.loads(
            block, object_pairs_hook=_Object, parse_constant=_no_constant, parse_int=float, parse_float=float
        )
        if items is None:
            return "no_json", []
        if not isinstance(items, list) or isinstance(items, _Object):
            raise _Mismatch("not an array")
        records = [_record(item) for item in items]
    except (ValueError, RecursionError):
        return "bad_json", []
    return ("ok", records) if records else ("no_json", [])
