"""JSON texts: stable form and key, recovery of a leading value, removal of secrets."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a secret looks like.
SECRET, BEARER = r"\bsk-[A-Za-z0-9_-]{12,}\b", r"(?i)Bearer\s+[^\s\"']+"


def stable(value) -> str:
    """Compact JSON with the keys of all objects in code-point order."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def cache_key(value) -> str:
    return hashlib.sha256(stable(value).encode()).hexdigest()


@F.pandas_udf(StringType())
def stable_json(texts: pd.Series) -> pd.Series:
    """The stable form of JSON texts; null for texts that aren't JSON."""

    def form(text):
        try:
            return None if text is None else stable(json.loads(text))
        except ValueError:
            return None

    return texts.map(form)


def content_key(text: Column) -> Column:
    """SHA-256 of a text's stable form: the key of a memo table."""
    return F.sha2(stable_json(text), 256)


@F.pandas_udf(StringType())
def first_value(texts: pd.Series) -> pd.Series:
    """The first whole JSON object or array of a text that may have something behind it; null if there is none."""
    decoder = json.JSONDecoder()

    def recover(text):
        if text is None:
            return None
        text = text.strip()
        try:
            return stable(json.loads(text))
        except ValueError:
            pass
        if text[:1] not in ("{", "["):
            return None
        try:
            return stable(decoder.raw_decode(text)[0])
        except ValueError:
            return None

    return texts.map(recover)


def redacted(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, SECRET, "[REDACTED]"), BEARER, "Bearer [REDACTED]")


def holds_secret(text: Column) -> Column:
    return text.rlike(SECRET) | text.rlike(r"(?i)Bearer\s+")
