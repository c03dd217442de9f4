"""Text functions that Spark has no built-in for: composed forms, BLAKE2b, sequence similarity, clauses. Arrow batches."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Canonical composition, with runs of white space as one blank; null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(StringType())
def blake2b_5(text: pd.Series) -> pd.Series:
    """BLAKE2b of 5 bytes, as hex."""
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=5).hexdigest())


@F.pandas_udf(StringType())
def pair_split(session: pd.Series) -> pd.Series:
    """Split of a session: two bytes of BLAKE2b modulo 100, below 5 test, below 10 val."""

    def one(t):
        if t is None:
            return None
        bucket = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=2).digest(), "big") % 100
        return "test" if bucket < 5 else "val" if bucket < 10 else "train"

    return session.map(one)


@F.pandas_udf(BooleanType())
def held_out(session: pd.Series) -> pd.Series:
    """Whether eight bytes of BLAKE2b are divisible by 10."""
    return session.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % 10 == 0)


@F.pandas_udf(DoubleType())
def similarity(one: pd.Series, two: pd.Series) -> pd.Series:
    """Ratio of matching words, longest common runs first; nothing counts as junk. Empty texts are alike."""
    pairs = zip(one.fillna(""), two.fillna(""), strict=True)
    return pd.Series([SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio() for a, b in pairs])


def safe_name(text):
    """A column as a file-name part: other characters as dashes, 36 at most, then a digest of the whole."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", ""), 1, 36)
    return F.concat(F.when(clean == "", "session").otherwise(clean), F.lit("-"), blake2b_5(text))


_END = re.compile(r"[.!?؟؛،,:;]$")


def clauses(text: str, first: int = 2, least: int = 4, most: int = 14) -> list[str]:
    """Clauses of a text for speech: cut after punctuation once there are enough words (fewer for the first), or at `most` words."""
    out, own = [], []
    for word in text.split():
        own.append(word)
        enough = first if not out else least
        if len(own) >= most or _END.search(word) and len(own) >= enough:
            out.append(" ".join(own))
            own = []
    return out + ([" ".join(own)] if own else [])


@F.pandas_udf(ArrayType(StringType()))
def clause_list(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [] if t is None else clauses(t))
