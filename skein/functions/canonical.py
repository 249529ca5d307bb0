"""Hashes of JSON values that ignore how a value is spelled."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(text: str):
    """Equal numbers alike: 1, 1.0 and 1e0 are one value, exact at any size."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        return _Num(f"n{text}")
    sign, digits, exponent = value.as_tuple()
    body = "".join(map(str, digits)).lstrip("0")
    kept = body.rstrip("0")
    if not kept:
        return _Num("n0")
    return _Num(f"n{'-' * sign}{kept}e{exponent + len(body) - len(kept)}")


class _Num(str):
    """A number's spelling, told from a string of the same letters."""

    __slots__ = ()


def _mark(value):
    if isinstance(value, dict):
        return {k: _mark(v) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_mark(v) for v in value]
    if isinstance(value, _Num):
        return {"\x00n": str(value)}
    return value


def canonical_text(text: str | None) -> str | None:
    """One spelling for all JSON texts of an equal value.

    Members that are null count as absent, at every depth; the order of members
    means nothing, that of array elements does. None for what is no JSON.
    """
    if text is None:
        return None
    try:
        value = json.loads(text, parse_int=_number, parse_float=_number)
    except (ValueError, RecursionError):
        return None
    return json.dumps(_mark(value), sort_keys=True, separators=(",", ":"))


def _hash(text: str | None) -> bytes:
    canonical = canonical_text(text)
    if canonical is None:
        canonical = "\x01null" if text is None else f"\x01raw{text}"
    return hashlib.blake2b(canonical.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@F.pandas_udf(T.BinaryType())
def json_digest(texts: pd.Series) -> pd.Series:
    """16 bytes, equal for texts of equal JSON value.

    A text that is no JSON equals only the same text; a null equals a null.
    """
    known: dict = {}
    out = []
    for text in texts:
        got = known.get(text)
        if got is None:
            got = known[text] = _hash(text)
        out.append(got)
    return pd.Series(out, dtype=object)
