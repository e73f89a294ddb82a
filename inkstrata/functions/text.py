"""Text functions as Column expressions (positions and lengths in code points)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What ends a sentence and a clause, what marks an annotation.
SENTENCE_END = "。！？!?；;"
CLAUSE_END = "，," + SENTENCE_END
ANNOTATION = "()（）"
HAN_RANGES = "\\x{2E80}-\\x{2FDF}\\x{3005}\\x{3007}\\x{3021}-\\x{3029}\\x{3038}-\\x{303B}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(column: Column) -> Column:
    """Canonical composition; Spark has no such function, so texts go through an Arrow batch."""
    return _nfc(column)


def split_sentences(column: Column) -> Column:
    """Sentences with their closing mark, trimmed, without empty ones."""
    pieces = F.regexp_extract_all(column, F.lit(f"[^{SENTENCE_END}]+[{SENTENCE_END}]?"), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def split_clauses(column: Column) -> Column:
    pieces = F.regexp_extract_all(column, F.lit(f"[^{CLAUSE_END}]+[{CLAUSE_END}]?"), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def han_only(column: Column) -> Column:
    return F.regexp_replace(column, f"[^{HAN_RANGES}]", "")


def simplified(column: Column, raw: str, normal: str) -> Column:
    """Characters of ``raw`` replaced by those at the same place of ``normal`` (an alias dimension, see ``alias_strings``)."""
    return F.translate(column, raw, normal)


def alias_strings(aliases) -> tuple[str, str]:
    """The two strings ``simplified`` needs, from a one-to-one alias table of single characters (a closed script mapping)."""
    rows = aliases.select("raw", "normalized").where("char_length(raw) = 1 and char_length(normalized) = 1").distinct().orderBy("raw").collect()
    return "".join(r.raw for r in rows), "".join(r.normalized for r in rows)


def search_text(column: Column, raw: str, normal: str) -> Column:
    """What is searched: composed, in simplified script, Han characters only."""
    return han_only(simplified(nfc(column), raw, normal))


def bucket_of(character: Column) -> Column:
    """Index bucket: the code point's upper part in hex, at least three digits."""
    code = F.hex(F.floor(F.ascii(character) / 256).cast("bigint"))
    return F.lower(F.when(F.length(code) < 3, F.lpad(code, 3, "0")).otherwise(code))


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Rounds halves towards positive infinity on the double itself (unlike ``round``)."""
    factor = float(10**digits)
    return F.floor(value * factor + 0.5) / factor


def annotations(column: Column) -> Column:
    return F.regexp_count(column, F.lit(f"[{ANNOTATION}]"))


def evidence_rank(text: Column, normalized: Column) -> Column:
    """Rank of a passage as evidence, smaller is better: short, punctuated, little annotated; at most 65535."""
    pause = F.when(text.rlike(f"[{SENTENCE_END}]"), 0).otherwise(200)
    return F.least(F.char_length(normalized) + pause + F.least(annotations(text), F.lit(10)) * 100, F.lit(65535))


def mining_penalty(text: Column, normalized: Column) -> Column:
    return F.char_length(normalized) + F.least(annotations(text), F.lit(10)) * 80


def characters(column: Column) -> Column:
    """The code points of a text as an array; empty for an empty text."""
    return F.when(F.char_length(column) > 0, F.split(column, "")).otherwise(F.array().cast("array<string>"))


def given_query(column: Column, surname: str) -> Column:
    """At most two ideographs of a query, without one leading surname."""
    found = F.regexp_extract_all(column, F.lit("[\\x{3400}-\\x{9FFF}]"), F.lit(0))
    bare = F.when(F.get(found, 0) == surname, F.slice(found, 2, 2)).otherwise(F.slice(found, 1, 2))
    return F.array_join(bare, "")


def indexed_text(column: Column) -> Column:
    """``[i]c`` for every character, joined by blanks."""
    return F.array_join(F.transform(characters(column), lambda c, i: F.concat(F.lit("["), i.cast("string"), F.lit("]"), c)), " ")


def indexed_length(column: Column) -> Column:
    """The length of ``indexed_text`` without building it: 3 signs and a blank a character, and the digits of all indices."""
    n = F.char_length(column)
    digits = sum((F.greatest(n - 10**k, F.lit(0)) for k in range(1, 10)), n)
    return F.when(n > 0, 4 * n - 1 + digits).otherwise(0)


def source_family(column: Column) -> Column:
    """A source with the title within 《…》 cut at its first middle dot; sources without such a title stay."""
    root = F.substring_index(F.regexp_extract(column, "《([^》]*)》", 1), "·", 1)
    return F.when(column.rlike("《[^》]*》"), F.concat(F.substring_index(column, "《", 1), F.lit("《"), root, F.lit("》"))).otherwise(column)


def pinyin_key(column: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "")


def chunks(column: Column, raw: str, normal: str, most: int = 180) -> Column:
    """Sentences joined greedily into chunks of at most ``most`` searchable characters; chunks without any are left out.

    A longer sentence is cut after every ``most`` searchable characters, each cut beginning with the last character before it. The
    text must be composed (see ``nfc``).
    """
    searchable = lambda c: F.char_length(han_only(simplified(c, raw, normal)))
    flags = lambda s: han_only(simplified(s, raw, normal))
    step = most - 1

    def cut(sentence: Column) -> Column:
        chars = F.split(sentence, "")
        size = F.char_length(sentence)
        at = F.filter(F.transform(chars, lambda c, i: F.when(F.char_length(flags(c)) > 0, i)), lambda i: i.isNotNull())
        count = F.size(at)
        # Cut k begins at searchable character k * step, if there is anything behind it.
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((count - 1) / step).cast("int"))), lambda k: (k == 0) | (F.get(at, k * step) + 1 < size))
        piece = lambda k: F.trim(F.array_join(F.slice(chars, F.when(k == 0, 0).otherwise(F.get(at, k * step)) + 1, F.coalesce(F.get(at, k * step + step) + 1, size) - F.when(k == 0, 0).otherwise(F.get(at, k * step))), ""))
        return F.when(count <= most, F.array(sentence)).otherwise(F.filter(F.transform(starts, piece), lambda p: p != ""))

    units = F.flatten(F.transform(split_sentences(column), cut))
    start = F.struct(F.lit("").alias("current"), F.array().cast("array<string>").alias("done"))

    def join(state: Column, unit: Column) -> Column:
        both = F.concat(state.current, unit)
        full = (state.current != "") & (searchable(both) > most)
        return F.struct(F.when(full, unit).otherwise(both).alias("current"), F.when(full, F.array_append(state.done, state.current)).otherwise(state.done).alias("done"))

    joined = F.aggregate(units, start, join, lambda s: F.when(s.current != "", F.array_append(s.done, s.current)).otherwise(s.done))
    return F.filter(joined, lambda c: searchable(c) > 0)
