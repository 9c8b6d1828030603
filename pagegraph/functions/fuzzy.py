"""Similarities that no built-in function has (T04-T07, T09, T10), as Arrow-batched functions; compared once per distinct pair."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

# How alike two tokens, two short tokens, two surnames and two titles have to be.
TOKEN, SHORT_TOKEN, SHORT, SURNAME, TITLE = 0.7, 0.6, 4, 0.5, 0.75


@lru_cache(1 << 16)
def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all of them; depends on the order of its arguments."""
    return SequenceMatcher(None, a, b).ratio()


def tokens_match(a: str, b: str) -> bool:
    """Equal, or alike enough for their length."""
    if a == b:
        return True
    alike = ratio(a, b)
    return alike >= TOKEN or (max(len(a), len(b)) <= SHORT and alike >= SHORT_TOKEN)


def keys_equivalent(a: str | None, b: str | None) -> bool:
    """Each token of the shorter name key has a partner of its own in the other one, taken in order."""
    if not a or not b:
        return False
    few, many = sorted((a.split("|"), b.split("|")), key=len)
    free = list(many)
    for token in few:
        partner = next((x for x in free if tokens_match(token, x)), None)
        if partner is None:
            return False
        free.remove(partner)
    return True


def titles_alike(a: str | None, b: str | None) -> bool:
    """Title keys that are equal, one inside the other, or alike."""
    if not a or not b:
        return False
    return a == b or a in b or b in a or ratio(a, b) >= TITLE


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """T04."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(BooleanType())
def authors_equivalent(a: pd.Series, b: pd.Series) -> pd.Series:
    """T06, of name keys."""
    return pd.Series([keys_equivalent(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(BooleanType())
def authors_conflict(a: pd.Series, b: pd.Series) -> pd.Series:
    """T07, of name keys: both there, and not equivalent."""
    return pd.Series([bool(x) and bool(y) and not keys_equivalent(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(BooleanType())
def titles_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    """T10, of title keys."""
    return pd.Series([titles_alike(x, y) for x, y in zip(a, b, strict=True)], dtype="bool")


@F.pandas_udf(StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """T01 for all of Unicode."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
