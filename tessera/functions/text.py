"""Text expressions: folding, the three tokenisers, answer normalisation, phrases and natural version keys.

All are Column expressions that stay inside code generation; ``fold_exact`` is the Arrow-batched form for text outside
the reach of ``lower`` (compatibility characters, full case folding).
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the search tokeniser, of the baseline tokeniser, and a capitalised phrase of up to three words.
SEARCH_TOKEN = r"[a-z0-9_ı]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
BASELINE_TOKEN = r"[A-Za-z0-9]+|[\x{3400}-\x{9FFF}]"
PHRASE = r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]*(?:[ -][A-Z][a-zA-Z]*){0,2}(?![\p{L}\p{N}_])"


def fold(text: Column) -> Column:
    """Case folding for text without compatibility characters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """NFKC, then full case folding. Apply it to distinct values and join back where texts repeat."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def tokens(text: Column, folded: bool = False) -> Column:
    """Words of the search tokeniser, in order."""
    return F.regexp_extract_all(text if folded else fold(text), F.lit(SEARCH_TOKEN), F.lit(0))


def baseline_tokens(text: Column) -> Column:
    """Words of the baseline tokeniser: ASCII letters and digits, folded after matching."""
    return F.transform(F.regexp_extract_all(text, F.lit(BASELINE_TOKEN), F.lit(0)), F.lower)


def normal_answer(text: Column) -> Column:
    """An answer as compared: folded, without commas, words joined by a space."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(text), F.lit(","), F.lit("")), F.lit(BASELINE_TOKEN), F.lit(0)), " ")


def phrases(text: Column) -> Column:
    """Distinct capitalised phrases."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)))


def subqueries(text: Column) -> Column:
    """The question and each quoted phrase in it, blanks collapsed, distinct."""
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    quoted = F.transform(F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1)), clean)
    return F.array_distinct(F.filter(F.concat(F.array(clean(text)), quoted), lambda x: x != ""))


def composed_query(*pieces: Column) -> Column:
    """Pieces of a request (query, goal, hints) joined by blanks: blank ones go, and of those equal but for case the first stays."""
    some = F.filter(F.array(*(F.coalesce(stripped(p), F.lit("")) for p in pieces)), lambda p: p != "")
    begin = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        return F.when(F.array_contains(acc["seen"], fold(p)), acc).otherwise(F.struct(F.array_append(acc["seen"], fold(p)).alias("seen"), F.array_append(acc["out"], p).alias("out")))

    return F.array_join(F.aggregate(some, begin, step)["out"], " ")


def version_key(version: Column) -> Column:
    """A key that orders versions naturally: runs of digits as numbers, and before runs of text."""
    parts = F.regexp_extract_all(version, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(
        parts,
        lambda p: F.struct(F.when(p.rlike("^[0-9]"), 0).otherwise(1).alias("kind"), F.when(p.rlike("^[0-9]"), p.cast("long")).otherwise(F.lit(0).cast("long")).alias("number"), F.when(p.rlike("^[0-9]"), "").otherwise(F.lower(p)).alias("word")),
    )


_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"


def stripped(text: Column) -> Column:
    """A text without blanks of any kind at either end."""
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def plain(text: Column) -> Column:
    """A text as it is stored: CRLF and CR as line feeds, no blanks at the ends of lines. (NFKC is ``fold_exact``'s part.)"""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?m)[\s\x1c-\x1f\x85\p{Z}&&[^\n]]+$", "")


def comparison_key(text: Column) -> Column:
    """What is compared of a text: folded, without blanks."""
    return F.regexp_replace(fold(text), _BLANK, "")


def uuid5(namespace: str, name: Column) -> Column:
    """The version-5 UUID of a name: SHA-1 of the namespace and the name, with the version and variant bits set."""
    space = uuid.UUID(namespace).bytes
    h = F.sha1(F.concat(F.lit(space), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays below its root: not empty or absolute, no drive, back slash, NUL or parent step."""
    return (path != "") & ~path.rlike(r"^(?:/|~|[A-Za-z]:)") & ~path.rlike(r"[\\\x00]") & ~path.rlike(r"(?:^|/)\.\.(?:/|$)")


def slug(name: Column) -> Column:
    """Whether a name may be part of a file name: letters, digits, dot, dash and underscore, beginning with a letter or digit."""
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$")


def md5_number(text: Column) -> Column:
    """A 60-bit number from a text's MD5: the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
