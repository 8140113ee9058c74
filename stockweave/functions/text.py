"""Text folding for search."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from stockweave.functions.columns import col


def fold_text(text: str) -> str:
    """:func:`fold` of one text, such as a search term."""
    return re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", text).lower())


def fold(text) -> Column:
    """Compatibility-decomposed, lower case, without accents or anything but ``a-z0-9``.

    The JVM has no normalising function, so texts with other than ASCII characters go through one in Arrow batches; the others stay in the JVM.
    """
    @F.arrow_udf("string")
    def decomposed(texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(pc.utf8_lower(pc.utf8_normalize(texts, form="NFKD")), pattern="[^a-z0-9]", replacement="")

    plain = col(text).rlike(r"^\p{ASCII}*$")
    return F.when(plain, F.regexp_replace(F.lower(col(text)), "[^a-z0-9]", "")).otherwise(decomposed(F.when(~plain, col(text))))
