"""Words of texts, whatever their case, punctuation, spacing, markup and compatible character forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compatible_form(c: Column | str) -> Column:
    """Unicode NFKC. Only texts with characters beyond ASCII leave the JVM."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def plain_text(c: Column | str) -> Column:
    """Lower-case words between single blanks, with a blank at each end; '' and null give ' ' and null."""
    t = compatible_form(c)
    t = F.regexp_replace(t, r"[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    t = F.regexp_replace(t, r"<!--.*?-->|</?[A-Za-z][^<>]*>|&(?:[A-Za-z]{2,8}|#\d{1,7});", " ")
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(t), F.lit(" ")), r"[^\p{L}\p{M}\p{N}]+", " ")


def words_of(plain: Column | str) -> Column:
    """The words of plain_text(); none for null."""
    return F.filter(F.split(F.coalesce(plain, F.lit("")), " "), lambda w: w != "")
