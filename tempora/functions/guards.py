"""Column expressions that reject: a guard gives an error code for a row that breaks a rule, and NULL for a sound one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
UUID_V7 = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-7[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
SHA256_ANY = r"^[0-9a-fA-F]{64}$"
SHA256_LOWER = r"^[0-9a-f]{64}$"
COMMIT = r"^([0-9a-f]{40}|[0-9a-f]{64})$"


class InvalidRows(ValueError):
    """Rows that a guard rejected; `codes` counts them."""

    def __init__(self, codes: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in sorted(codes.items())))
        self.codes = codes


def code(condition: Column, name: str) -> Column:
    """`name` where the condition is true; a NULL condition doesn't break a rule."""
    return F.when(condition, F.lit(name))


def first_code(*codes: Column) -> Column:
    """The first rule that is broken, in order of precedence."""
    return F.coalesce(*codes)


def finite(x: Column) -> Column:
    """NULL, NaN and infinities aren't."""
    d = x.cast("double")
    return x.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))


def blank(x: Column) -> Column:
    return x.isNull() | (F.length(F.trim(x)) == 0)


def is_sha256(x: Column, lowercase: bool = True) -> Column:
    return F.coalesce(x.rlike(SHA256_LOWER if lowercase else SHA256_ANY), F.lit(False))


def is_uuid(x: Column, v7: bool = False) -> Column:
    return F.coalesce(x.rlike(UUID_V7 if v7 else UUID), F.lit(False))


def one_of(x: Column, names: list[str] | tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(list(names)), F.lit(False))


def is_label(x: Column, most: int = 256) -> Column:
    """A label that isn't blank, has no control character and `most` bytes at most."""
    return ~blank(x) & ~F.coalesce(x.rlike(r"\p{Cntrl}"), F.lit(False)) & (F.octet_length(x) <= most)


def with_code(df: DataFrame, *codes: Column, name: str = "error_code") -> DataFrame:
    return df.withColumn(name, first_code(*codes))


def assert_valid(df: DataFrame, name: str = "error_code") -> DataFrame:
    """`df` without the code column; raises InvalidRows where a row has a code. One aggregation, of a few codes."""
    found = {r[name]: r["n"] for r in df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()}
    if found:
        raise InvalidRows(found)
    return df.drop(name)
