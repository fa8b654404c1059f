"""Unicode-exact text functions as Column expressions; Python only where Spark has no builtin."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOFT_HYPHEN = "\u00ad"


@F.pandas_udf(T.StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no builtin for it."""
    return x.map(lambda s: s if s is None or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def nfkc_casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda s: s if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def without_marks(x: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    return x.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def casefold(x: Column) -> Column:
    """Case folding without leaving the JVM, for text that is composed and holds no compatibility characters."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def collapse(x: Column) -> Column:
    """White space, Unicode's too, collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def display_text(x: Column) -> Column:
    """NFKC and collapsed white space; accents stay."""
    return collapse(nfkc(x))


def fold_for_matching(x: Column) -> Column:
    """Upper case without accents; all but A-Z and 0-9 become single blanks."""
    return F.trim(F.regexp_replace(F.upper(without_marks(x)), "[^A-Z0-9]+", " "))


def fold_visible(x: Column) -> Column:
    """Upper case without accents, white space collapsed."""
    return F.upper(collapse(without_marks(x)))


def fold_lines(x: Column) -> Column:
    """As ``fold_visible``, but line by line."""
    lines = F.split(without_marks(x), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]")
    return F.upper(F.array_join(F.transform(lines, lambda l: F.trim(F.regexp_replace(l, r"[ \t\f\x0b]+", " "))), "\n"))


def extracted_text(x: Column) -> Column:
    """NFKC, horizontal white space collapsed, blank lines dropped, line breaks kept."""
    lines = F.split(nfkc(x), r"\r\n|[\n\r]")
    return F.array_join(F.filter(F.transform(lines, lambda l: collapse(l)), lambda l: l != ""), "\n")


def clean_text(x: Column) -> Column:
    """Struct with the repaired, folded text and counts of the repairs.

    Words cut by soft hyphens, or by a hyphen before white space, are joined.  One
    pass is enough: a join leaves letters on both sides, so it makes no new cut.
    """
    letter, blank = r"[\p{L}\p{Nl}\p{No}]", r"(?U:[\s\x1c-\x1f])"  # as Python's patterns have them
    soft, hard = rf"(?<={letter})\x{{AD}}{blank}*(?={letter})", rf"(?<={letter})-{blank}+(?={letter})"
    joined = F.replace(F.regexp_replace(x, soft, ""), F.lit(SOFT_HYPHEN), F.lit(""))
    return F.struct(
        nfkc_casefold(F.regexp_replace(joined, hard, "")).alias("text"),
        F.regexp_count(x, F.lit(soft)).cast("long").alias("soft_joins"),
        F.regexp_count(x, F.lit(r"\x{AD}")).cast("long").alias("soft_removed"),
        F.regexp_count(joined, F.lit(hard)).cast("long").alias("hyphen_joins"),
    )


def clusters(folded: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.filter(F.split(folded, r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def lexical_tokens(folded: Column) -> Column:
    """Runs that are letters only and have three at least; a run with a digit is dropped whole."""
    return F.filter(F.split(folded, r"[^\p{L}\p{Nd}]+"), lambda t: t.rlike(r"^\p{L}{3,}$"))


def words(x: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(x, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def token_class(t: Column) -> Column:
    return F.when(t.rlike(r"^\p{L}+$"), "alphabetic").when(t.rlike(r"^\p{Nd}+$"), "numeric").otherwise("mixed_alphanumeric")


def length_class(t: Column) -> Column:
    n = F.length(t)
    return F.when(n == 1, "length_1").when(n == 2, "length_2").otherwise("length_3_plus")


def excerpt(x: Column, limit: int, mark: str = "") -> Column:
    """Start of the collapsed text; ``mark`` follows where something is left out."""
    whole = collapse(x)
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, limit)), F.lit(mark)))


def snippet(x: Column, value: Column, around: int = 60, limit: int = 180) -> Column:
    """Text around the first place of ``value``, with dots where it is cut."""
    at = F.instr(x, value)
    first = F.greatest(F.lit(1), at - around)
    last = F.least(F.length(x), at + F.length(value) - 1 + around)
    body = collapse(F.substring(x, first, last - first + 1))
    whole = F.concat(F.when(first > 1, "...").otherwise(""), body, F.when(last < F.length(x), "...").otherwise(""))
    return F.when(at == 0, F.substring(collapse(x), 1, limit)).otherwise(F.substring(whole, 1, limit))


def label_text(x: Column) -> Column:
    """A folded label without marks at its ends."""
    return F.regexp_replace(fold_visible(x), "^[ .,:;–—-]+|[ .,:;–—-]+$", "")


def safe_ratio(n: Column, d: Column, digits: int = 10) -> Column:
    return F.round(F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0)), digits)


def percentage(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def is_folded_label(pattern: str, x: Column) -> Column:
    """Whether some folded line matches a pattern in full."""
    return F.exists(F.split(x, "\n"), lambda l: F.trim(l).rlike(f"^(?:{pattern})$"))

