"""Canonical JSON, content hashes and deep redaction of open-shaped JSON.

Spark has no expression for these, so they are Arrow-batched pandas UDFs over the
JSON text; everything with a known shape should use native functions instead.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import patterns as pt


def js_number(x: float | int) -> str:
    """A number as an ECMAScript engine prints it."""
    x = float(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    if abs(x) < 2**53 and x == int(x):
        return str(int(x))
    digits, exp = repr(abs(x)), 0
    if "e" in digits:
        digits, e = digits.split("e")
        exp = int(e)
    whole, _, frac = digits.partition(".")
    frac = "" if frac == "0" else frac
    point = len(whole) + exp
    ds = (whole + frac).lstrip("0")
    point -= len(whole + frac) - len(ds)
    ds = ds.rstrip("0") or "0"
    sign = "-" if x < 0 else ""
    if 0 < point <= 21:
        body = ds + "0" * (point - len(ds)) if point >= len(ds) else ds[:point] + "." + ds[point:]
    elif -6 < point <= 0:
        body = "0." + "0" * -point + ds
    else:
        e = point - 1
        body = ds[0] + ("." + ds[1:] if len(ds) > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))
    return sign + body


def canonical(value) -> str:
    """Keys in UTF-16 order, no spaces, numbers in ECMAScript form."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, (int, float)):
        return js_number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(value[k]) for k in keys) + "}"


def canonical_json(text: Column) -> Column:
    """JSON text in canonical form; null stays null, invalid JSON gives null."""

    @F.pandas_udf("string")
    def convert(batch: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                return canonical(json.loads(s))
            except ValueError:
                return None

        return batch.map(one, na_action=None)

    return convert(text)


def content_hash(text: Column) -> Column:
    """``sha256:<hex>`` of the canonical form of JSON text; only the canonical form leaves the JVM."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(text), 256))


def nfc(text: Column) -> Column:
    """Unicode NFC.  Text below U+0300 is already composed and never leaves the JVM."""

    @F.pandas_udf("string")
    def compose(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: None if s is None else unicodedata.normalize("NFC", s), na_action=None)

    odd = F.when(text.rlike("[^\\u0000-\\u02ff]"), text)
    return F.coalesce(compose(odd), text)


_SECRETS = [re.compile(pt.for_python(p), re.A | (re.I if i else 0)) for p, i in pt.SECRETS]
_HIDDEN = re.compile(f"[{pt.char_class(pt.CONTROL + pt.BIDI)}]")
_KEY = re.compile(pt.SENSITIVE_KEY, re.I)


def _clean(text: str) -> str:
    return _HIDDEN.sub("", unicodedata.normalize("NFC", text))


def scrub(text: str) -> str:
    out = _clean(text)
    for p in _SECRETS:
        out = p.sub(pt.REDACTED, out)
    return out


def _scrubbed(value):
    """Strings without credentials, also those of a list; objects come here already done."""
    if isinstance(value, str):
        return scrub(value)
    return [_scrubbed(v) for v in value] if isinstance(value, list) else value


def _members(pairs: list) -> dict:
    """Members of one object: text, lists and objects under a sensitive name are hidden, numbers and nulls tell nothing."""
    hide = lambda name, value: isinstance(value, (str, list, dict)) and _KEY.search(name) is not None
    return {_clean(name): pt.REDACTED if hide(name, value) else _scrubbed(value) for name, value in pairs}


def redacted(text: str):
    """JSON text, read without credentials: the parser hands over every object from the inside out."""
    return _scrubbed(json.loads(text, object_pairs_hook=_members))


def shortened(value, depth: int | None = None, chars: int | None = None, entries: int | None = None):
    """At most so many levels, characters of a text, and items or members; what is left out shows as ``…``."""
    if isinstance(value, str):
        return value if chars is None or len(value) <= chars else value[:chars] + "…"
    if not isinstance(value, (list, dict)):
        return value
    if depth == 0:
        return "…"
    below = None if depth is None else depth - 1
    rest = entries is not None and len(value) > entries
    if isinstance(value, list):
        return [shortened(v, below, chars, entries) for v in value[:entries]] + ["…"] * rest
    few = {k: shortened(value[k], below, chars, entries) for k in list(value)[:entries]}
    return {**few, "…": len(value) - len(few)} if rest else few


def redact_json(text: Column, depth: int | None = None, chars: int | None = None, entries: int | None = None) -> Column:
    """Redacted, compact JSON text; invalid JSON gives null.  Nothing is shortened unless a limit is given."""

    @F.pandas_udf("string")
    def clean(batch: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                return json.dumps(shortened(redacted(s), depth, chars, entries), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return batch.map(one, na_action=None)

    return clean(text)
