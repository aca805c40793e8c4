"""Subject codes and author lists as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# List delimiter, code pattern and code lengths.
DELIMITER = "|"
CODE_PATTERN = r"\d\d\w\d\d"
CODE_LENGTHS = (2, 3, 5)


def check_depth(depth: int) -> int:
    if depth not in CODE_LENGTHS:
        raise ValueError(f"code depth must be one of {CODE_LENGTHS}, not {depth}")
    return depth


def join_authors(authors: Column) -> Column:
    """``keyname,forenames`` of each author, packed with the delimiter."""
    named = F.transform(
        authors,
        lambda a: F.concat(
            F.coalesce(a["keyname"], F.lit("")), F.lit(","), F.coalesce(a["forenames"], F.lit(""))
        ),
    )
    return F.coalesce(F.array_join(named, DELIMITER), F.lit(""))


def extract_codes(text: Column) -> Column:
    """All codes found in a free-text field, packed with the delimiter."""
    found = F.regexp_extract_all(text, F.lit(CODE_PATTERN), F.lit(0))
    return F.coalesce(F.array_join(found, DELIMITER), F.lit(""))


def split_codes(packed: Column) -> Column:
    return F.split(packed, r"\|", -1)


def codes_at_depth(codes: Column, depth: int) -> Column:
    """Distinct prefixes of the given length, in order of first occurrence."""
    return F.array_distinct(F.transform(codes, lambda code: F.substring(code, 1, depth)))
