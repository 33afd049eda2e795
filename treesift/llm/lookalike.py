"""Visually identical text: one consistent form, classes of look-alikes, and the pairs that collide."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import runtime

# Letters drawn like a Latin letter, after the letter they look like.
LOOK_ALIKES = {
    "cyrillic small": "а=a с=c ԁ=d е=e һ=h і=i ј=j ӏ=l о=o р=p ԛ=q ѕ=s ѵ=v ԝ=w х=x у=y ү=y",
    "cyrillic capital": "А=A В=B С=C Е=E Ԍ=G Н=H І=I Ӏ=I Ј=J К=K М=M О=O Р=P Ԛ=Q Ѕ=S Т=T Ѵ=V Ԝ=W Х=X У=Y Ү=Y",
    "greek small": "α=a γ=y ι=i ν=v ο=o ρ=p υ=u ϳ=j",
    "greek capital": "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X Ϳ=J",
    "armenian": "օ=o ո=n ս=u հ=h զ=q ց=g Տ=S Լ=L Օ=O Ս=U",
    "cherokee": "Ꭺ=A Ᏼ=B Ꮯ=C Ꭰ=D Ꭼ=E Ꮐ=G Ꮋ=H Ꭻ=J Ꮶ=K Ꮮ=L Ꮇ=M Ꮲ=P Ꭱ=R Ꮪ=S Ꭲ=T Ꮩ=V Ꮃ=W Ꮓ=Z",
    "coptic": "ⲟ=o Ⲟ=O ⲣ=p Ⲣ=P ⲥ=c Ⲥ=C",
    "phonetic": "ɑ=a ɡ=g ı=i",
}
# Hyphens and the minus sign, then invisible characters other than format characters.
HYPHENS = "‐‑−˗⁃﹣֊"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that are drawn.
DRAWN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"


@lru_cache(1)
def _table() -> dict[int, str | None]:
    """What each character of a decomposed text becomes; None for nothing."""
    table: dict[int, str | None] = {ord(p[0]): p[2] for line in LOOK_ALIKES.values() for p in line.split()}
    table |= dict.fromkeys(map(ord, HYPHENS), "-") | dict.fromkeys(map(ord, INVISIBLE), None)
    variants = [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
    formats = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and chr(c) not in DRAWN_FORMAT]
    return table | dict.fromkeys(variants, None) | dict.fromkeys(formats, None)


def skeleton(text: str) -> str:
    """The one form that all texts which look like `text` share: compatibility forms and special spaces become plain,
    invisible characters go, hyphens become '-', look-alike letters become Latin, marks join their letters."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFKD", text).translate(_table())
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKD", plain))


def _skeletons(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def with_skeleton(df: DataFrame, text: str) -> DataFrame:
    """`df` with the column `skeleton`; only texts beyond ASCII pass through Python. A null text has a null skeleton."""
    runtime.ship_package(df.sparkSession)
    skeleton_udf = F.pandas_udf(_skeletons, "string")
    plain = F.col(text).isNull() | ~F.col(text).rlike("[^\\x00-\\x7F]")
    return df.where(plain).withColumn("skeleton", F.col(text)).unionByName(df.where(~plain).withColumn("skeleton", skeleton_udf(text)))


def lookalike_members(df: DataFrame, key: str, scope: str, text: str) -> DataFrame:
    """(scope, key, text, canonical): every row whose text looks like another, different text of its scope.

    A pass over hashes finds the (scope, skeleton) with more than one spelling, so that only fixed-width values of all
    rows are shuffled. Their rows are grouped in SQL under the accent-sensitive UNICODE collation, which holds canonically
    equivalent spellings equal, and, as it holds control characters for nothing, by the skeleton; the least spelling by code
    points (so an ASCII one before others) is the canonical member, joined back to every row. Rows with a null scope, key or text are left out; repeated rows count once.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(scope).isNotNull() & F.col(text).isNotNull()).select(F.col(scope).alias("scope"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = with_skeleton(rows, "text").withColumn("look", F.xxhash64("skeleton"))
    spelt = F.xxhash64("text")
    several = rows.groupBy("scope", "look").agg(F.min(spelt).alias("__a"), F.max(spelt).alias("__b")).where(F.col("__a") != F.col("__b")).select("scope", "look")
    members = runtime.materialise(rows.join(several, ["scope", "look"], "left_semi").drop("look").distinct())
    shown = F.collate("skeleton", "UNICODE")
    best = members.groupBy("scope", shown.alias("shown"), "skeleton").agg(F.min("text").alias("canonical"))
    joined = members.withColumn("shown", shown).join(best, ["scope", "shown", "skeleton"])
    return joined.select("scope", "key", "text", "skeleton", "canonical")


def lookalike_pairs(members: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows of one scope and class whose texts differ.

    Rows meet on the class's canonical member and, as an exact check, on the skeleton itself. Pairs of equal texts are
    never made: they meet through the list of spellings, and the join of a class with very many rows is split by adaptive
    skew handling.
    """
    members = runtime.materialise(members)
    spellings = members.select("scope", "canonical", "skeleton", "text").distinct()
    other = spellings.select("scope", "canonical", "skeleton", F.col("text").alias("text_b"))
    near = members.join(other, ["scope", "canonical", "skeleton"]).where(F.col("text") != F.col("text_b")).select("scope", F.col("key").alias("key_a"), "text_b")
    b = members.select("scope", F.col("key").alias("key_b"), F.col("text").alias("text_b"))
    return near.join(b, ["scope", "text_b"]).where(F.col("key_a") < F.col("key_b")).select("key_a", "key_b").distinct()
