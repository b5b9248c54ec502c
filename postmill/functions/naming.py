"""Names of folders and files that messages are written under."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from postmill.functions import text, times

#: Names that no file may have on some systems. Fixed values.
RESERVED = frozenset(["con", "prn", "aux", "nul", *(f"{p}{k}" for p in ("com", "lpt") for k in range(1, 10))])
LONGEST = 96


def safe(name: str | None, fallback: str = "allegato") -> str:
    """One harmless path component that keeps accents and its ending, at most 96 characters."""
    clean = unicodedata.normalize("NFC", re.sub(r'[\x00-\x1f\x7f<>:"/\\|?*]', lambda m: " " if m[0] in "\t\r\n" else "_", name or ""))
    clean = " ".join(clean.split()).rstrip(". ")
    if not clean.strip("."):
        return fallback
    stem, dot, ending = clean.rpartition(".")
    if not stem or len(ending) > 12:
        stem, dot, ending = clean, "", ""
    if stem.lower() in RESERVED:
        stem = "_" + stem
    return stem[: LONGEST - len(dot + ending)].rstrip(". ") + dot + ending.replace(" ", "")


def unique(names: list[str | None]) -> list[str]:
    """Safe names of one message, different from each other in any letter case."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = candidate = safe(name)
        stem, dot, ending = base.rpartition(".") if "." in base else (base, "", "")
        n = 0
        while candidate.lower() in taken:
            n += 1
            tail = f"-{n}{dot}{ending}"
            candidate = stem[: LONGEST - len(tail)] + tail
        taken.add(candidate.lower())
        out.append(candidate)
    return out


@F.pandas_udf(ArrayType(StringType()))
def unique_names(names: pd.Series) -> pd.Series:
    """unique as an Arrow function over the array of a message's names."""
    return names.map(lambda x: unique(list(x)), na_action="ignore")


def folder(account: Column, subject: Column, date: Column, ident: Column) -> Column:
    """YYYYMMDD-HHMM_account_subject_id of a message; the date in the archive's zone."""
    local = F.from_utc_timestamp(times.instant(date), times.ZONE)
    return F.concat_ws("_", F.coalesce(F.date_format(local, "yyyyMMdd-HHmm"), F.lit("senza-data")), text.slug(account, 32), F.when(text.slug(subject, 44) != "", text.slug(subject, 44)).otherwise("senza-oggetto"), F.substring(ident, 1, 12))
