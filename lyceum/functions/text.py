"""String clean-up, hashing and masking expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Formats the extracts must have.
EMAIL_PATTERN = r"(?U)^[\w\.\+\-]+@[\w\-]+\.\w{2,}$"
STUDENT_ID_PATTERN = r"^STU\d{6}$"
INSTRUCTOR_ID_PATTERN = r"^INS\d{4}$"
TRUE_WORDS = ("true", "1", "yes")
NULL_TOKENS = ("NULL", "null", "")


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column in one projection."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.trim(F.col(n)) for n in names}) if names else df


def blank_to_null(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Replace the null spellings of the landing files by NULL in every string column."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: F.when(~F.col(n).isin(*tokens), F.col(n)) for n in names}) if names else df


def title_case(value: Column) -> Column:
    """Capital after every non-letter (``o'neil-smith`` -> ``O'Neil-Smith``), which ``initcap`` does not do."""
    runs = F.regexp_extract_all(F.lower(value), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def parse_flag(value: Column) -> Column:
    """``true``/``1``/``yes`` in any case is true, everything else false."""
    return F.coalesce(F.lower(value.cast("string")).isin(*TRUE_WORDS), F.lit(False))


def parse_number(value: Column, default: float | None = None) -> Column:
    """Number or ``default`` when the text is not a number."""
    number = value.try_cast("double")
    return number if default is None else F.coalesce(number, F.lit(default))


def matches(value: Column, pattern: str) -> Column:
    """Regex test in which NULL does not match."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def full_name(first: Column, last: Column) -> Column:
    """First and last name; NULL if either is NULL."""
    return F.concat(first, F.lit(" "), last)


def row_digest(*values: Column) -> Column:
    """MD5 over the text forms, ``|`` between fields and NULL as empty."""
    return F.md5(F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)))


def masked_email(value: Column) -> Column:
    """Keep two characters of the local part; a shorter local part is hidden as a whole."""
    return (
        F.when(value.rlike(r"^.{1,2}@"), F.regexp_replace(value, r"^[^@]*(@.+)$", r"***$1"))
        .otherwise(F.regexp_replace(value, r"(.{2}).+(@.+)", r"$1***$2"))
    )
