"""JSON documents as a stream of events, for nesting and numbers beyond what a recursive parser takes.

``load`` uses the parser of the standard library and reads the events only where that gives up, so ordinary documents cost
nothing extra.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORD = re.compile(r"null|true|false")
_WORDS = {"null": None, "true": True, "false": False}
#: Digits that ``int`` reads without a limit.
_DIGITS = 4000

# Kinds of events.
OBJECT, ARRAY, END, KEY, VALUE = "object", "array", "end", "key", "value"


class Real(str):
    """A number with a fraction or an exponent, as it is written."""


class Whole(str):
    """A whole number with too many digits for ``int``, as it is written."""


def _refuse(name: str):
    raise ValueError(name)


def events(text: str) -> Iterator[tuple[str, object]]:
    """``(kind, value)`` in document order: OBJECT, ARRAY and END of a container, KEY, VALUE of a scalar.

    One explicit stack with a flag for every open container; ValueError at the place where the text is no JSON.
    """
    inside: list[bool] = []  # open containers: True for objects
    at, done = _SPACE.match(text).end(), False

    def fail(what: str):
        raise ValueError(f"{what} expected at {at}")

    while not done:
        # A value begins here.
        mark = text[at : at + 1]
        if mark == "{" or mark == "[":
            inside.append(mark == "{")
            yield (OBJECT if mark == "{" else ARRAY), None
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if mark == "{" else "]"):
                if mark == "{":
                    key, at = _key(text, at)
                    yield KEY, key
                continue
        elif mark == '"':
            value, at = scanstring(text, at + 1)
            yield VALUE, value
        elif number := _NUMBER.match(text, at):
            whole, fraction, exponent = number.groups()
            at = number.end()
            real = fraction is not None or exponent is not None
            yield VALUE, Real(number[0]) if real else int(whole) if len(whole) < _DIGITS else Whole(whole)
        elif word := _WORD.match(text, at):
            at = word.end()
            yield VALUE, _WORDS[word[0]]
        else:
            fail("a value")
        # Behind a value, or at the end of an empty container: close what ends here, then go on.
        while True:
            at = _SPACE.match(text, at).end()
            if not inside:
                done = True
                break
            mark = text[at : at + 1]
            if mark == ("}" if inside[-1] else "]"):
                inside.pop()
                at += 1
                yield END, None
            elif mark == ",":
                at = _SPACE.match(text, at + 1).end()
                if inside[-1]:
                    key, at = _key(text, at)
                    yield KEY, key
                break
            else:
                fail("a comma or an end")
    if at != len(text):
        fail("no more text")


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"a key expected at {at}")
    key, at = scanstring(text, at + 1)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"a colon expected at {at}")
    return key, _SPACE.match(text, at + 1).end()


def build(stream: Iterator[tuple[str, object]]):
    """The document of a stream of events; the last of equal keys counts."""
    open_: list = []
    keys: list = []
    value = None
    for kind, given in stream:
        if kind == KEY:
            keys[-1] = given
            continue
        if kind in (OBJECT, ARRAY):
            open_.append({} if kind == OBJECT else [])
            keys.append(None)
            continue
        if kind == END:
            value = open_.pop()
            keys.pop()
        else:
            value = given
        if open_:
            if isinstance(open_[-1], dict):
                open_[-1][keys[-1]] = value
            else:
                open_[-1].append(value)
    return value


def load(text: str | None, real=Real):
    """The document in ``text`` at any depth and with numbers of any length; ValueError for text that is no JSON."""
    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text, parse_float=real, parse_constant=_refuse)
    except json.JSONDecodeError:
        raise
    except (RecursionError, ValueError):
        stream = events(text)
        if real is not Real:
            stream = ((kind, real(value) if isinstance(value, Real) else value) for kind, value in stream)
        return build(stream)


def dump(document) -> str:
    """JSON text of a document of any depth."""
    try:
        return json.dumps(document)
    except RecursionError:
        pass
    out: list[str] = []
    waiting: list = [document]
    while waiting:
        value = waiting.pop()
        if isinstance(value, _Text):
            out.append(value)
        elif isinstance(value, dict) and value:
            parts = [x for k, v in value.items() for x in (_Text(", "), _Text(json.dumps(k) + ": "), v)][1:]
            waiting += [_Text("}"), *reversed(parts), _Text("{")]
        elif isinstance(value, list) and value:
            parts = [x for v in value for x in (_Text(", "), v)][1:]
            waiting += [_Text("]"), *reversed(parts), _Text("[")]
        else:
            out.append(str(value) if isinstance(value, (Real, Whole)) else json.dumps(value))
    return "".join(out)


class _Text(str):
    """A finished part of a document's text."""
