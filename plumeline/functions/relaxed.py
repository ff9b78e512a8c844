"""Shell-style documents of text logs to JSON text, as one Arrow batch function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

from plumeline.functions.pull import load

# The tokens a shell document is made of, longest reading first.
_TOKEN = re.compile(
    r"""
      (?P<space>\s+)
    | (?P<mark>[{}\[\],:])
    | (?P<string>"(?:[^"\\]|\\.|"(?!\s*(?:[,:}\]]|\Z)))*"|'(?:[^'\\]|\\.)*')
    | (?P<date>(?:new\s*)?(?:Date|ISODate)\(([^)]*)\))
    | (?P<long>Number(?:Long|Int)\(\s*["']?(-?\d+)["']?\s*\))
    | (?P<binary>BinData\([^()]*\))
    | (?P<stamp>Timestamp\s+\d+\|\d+)
    | (?P<call>(?:new\s+)?[A-Za-z]\w*\([^)]*\))
    | (?P<regex>/(?:[^/\\]|\\.)+/[a-z]*(?=\s*[,}\]]))
    | (?P<word>[^\s{}\[\],:"']+(?:[:'"](?=[^\s{}\[\],])[^\s{}\[\],:"']*)*)
    """,
    re.VERBOSE | re.DOTALL,
)
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_INNER = re.compile(r"\((?:\s*[\"']?)(.*?)(?:[\"']?\s*)\)\Z", re.DOTALL)
_BARE = {"true": "true", "false": "false", "null": "null", "undefined": "null"}


def _string(text: str) -> str:
    """A quoted token as a JSON string."""
    body = text[1:-1]
    if "\\" not in body and '"' not in body and body.isprintable():
        return f'"{body}"'
    if text[0] == '"' and re.search(r'(?<!\\)"', body):
        # Quotes inside, with no escape in front.
        body = re.sub(r'(?<!\\)"', r'\\"', body)
    if text[0] == "'":
        body = body.replace("\\'", "'").replace('"', '\\"')
    try:
        body = json.loads(f'"{body}"', strict=False)
    except ValueError:
        pass
    return json.dumps(body, ensure_ascii=False)


def _value(kind: str, text: str, payload: bool) -> str:
    """Any other token as a JSON value; with ``payload`` a binary is its data alone."""
    if kind == "date":
        at = _INNER.search(text)[1]
        return f'{{"$date":{at if at.lstrip("-").isdigit() else json.dumps(at)}}}'
    if kind == "long":
        return _INNER.search(text)[1]
    if kind == "binary" and payload:
        # The payload, which is the last argument.
        return json.dumps(_INNER.search(text)[1].split(",")[-1].strip(" \"'"))
    if kind == "stamp":
        millis, step = text.split()[1].split("|")
        return f'"Timestamp({int(millis) // 1000},{step})"'
    if text in _BARE:
        return _BARE[text]
    return text if _NUMBER.match(text) else json.dumps(text, ensure_ascii=False)


def _is_document(text: str) -> bool:
    try:
        return isinstance(load(text), (dict, list))
    except ValueError:
        return False


def _normalise(text: str | None, payload: bool = False) -> str | None:
    """Compact JSON of the document, None when it cannot be read to its end."""
    if text is None:
        return None
    out, at, before = [], 0, ""
    for m in _TOKEN.finditer(text):
        if m.start() != at:
            return None
        kind, token, at = m.lastgroup, m.group(), m.end()
        if kind == "space":
            continue
        if kind == "mark":
            # What stands ahead of a colon is a key, whatever it looks like.
            if token == ":" and before:
                out[-1] = json.dumps(before, ensure_ascii=False)
            out.append(token)
            before = ""
        elif kind == "string":
            out.append(_string(token))
            before = ""
        else:
            out.append(_value(kind, token, payload))
            before = token
    joined = "".join(out)
    return joined if at == len(text) and _is_document(joined) else None


@F.pandas_udf(T.StringType())
def relaxed_to_json(documents: pd.Series) -> pd.Series:
    """JSON text of shell-style documents; NULL marks text that is none."""
    return pd.Series([_normalise(d) for d in documents], dtype=object)


@F.pandas_udf(T.StringType())
def stored_to_json(documents: pd.Series) -> pd.Series:
    """JSON text of stored command documents: as ``relaxed_to_json``, binaries as their data."""
    return pd.Series([_normalise(d, payload=True) for d in documents], dtype=object)
