"""The first JSON object in a text, found in one pass over it."""

from __future__ import annotations

import json
import re

TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<value>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|(?P<mark>[{}\[\],:]))')
#: What may come next, by what came last.
KEY_OR_END, KEY, COLON, VALUE, VALUE_OR_END, NEXT = range(6)


def _attempt(text: str, start: int) -> tuple[int | None, list[int], list[tuple[int, int]]]:
    """Reads on from a brace: where its object ends (None if it never does), which objects were left open, and which were whole."""
    stack, state, at, whole = [("{", start)], KEY_OR_END, start + 1, []
    while found := TOKEN.match(text, at):
        kind, at = found.lastgroup, found.end()
        mark = found["mark"] if kind == "mark" else ""
        inside = stack[-1][0]
        if kind == "string" and state in (KEY, KEY_OR_END):
            state = COLON
        elif mark == ":" and state == COLON:
            state = VALUE
        elif kind in ("string", "value") and state in (VALUE, VALUE_OR_END):
            state = NEXT
        elif mark in ("{", "[") and mark and state in (VALUE, VALUE_OR_END):
            stack.append((mark, at - 1))
            state = KEY_OR_END if mark == "{" else VALUE_OR_END
        elif mark == "," and state == NEXT:
            state = KEY if inside == "{" else VALUE
        elif (mark == "}" and inside == "{" and state in (NEXT, KEY_OR_END)) or (mark == "]" and inside == "[" and state in (NEXT, VALUE_OR_END)):
            opened = stack.pop()
            if opened[0] == "{":
                whole.append((opened[1], at))
            if not stack:
                return at, [], whole
            state = NEXT
        else:
            break
    return None, [i for mark, i in stack if mark == "{"], whole


def first_object(text: str) -> dict | None:
    """The object of the first brace that begins one. Braces that an attempt left open fail with it, so that nested ones aren't tried anew."""
    failed: set[int] = set()
    at = text.find("{")
    while at >= 0:
        if at not in failed:
            end, left_open, whole = _attempt(text, at)
            if end is not None:
                try:
                    return json.loads(text[at:end])
                except RecursionError:  # nested deeper than Python reads
                    return None
            failed.update(left_open)
            if whole and (inner := min(whole))[0] == text.find("{", at + 1):
                return json.loads(text[slice(*inner)])
        at = text.find("{", at + 1)
    return None
