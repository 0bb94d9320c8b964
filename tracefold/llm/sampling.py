"""Bounded samples for fitting."""

from pyspark.sql import DataFrame, functions as F

STEPS = 1 << 24


def thin_out(df: DataFrame, key: str, about: int) -> DataFrame:
    """Rows whose hashed key is small, so that about ``about`` rows remain; all if there are fewer.

    Every task keeps its share, so nothing is gathered to choose them.
    """
    rows = df.count()
    if rows <= about:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(STEPS)) < max(1, about * STEPS // rows))
