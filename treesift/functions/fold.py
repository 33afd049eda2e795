"""Case folding: names fold character by character, needles as whole strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_column(text: Column) -> Column:
    """Lower case of every character by itself: a final capital sigma becomes the same small sigma as any other."""
    return F.lower(F.translate(text, "Σ", "σ"))


def fold_text(text: str) -> str:
    """fold_column for one Python string."""
    return "".join(c.lower() for c in text)


def fold_needle(text: str) -> str:
    """Lower case of a whole needle, which knows a final sigma: such a needle doesn't match a folded name, by design."""
    return text.lower()
