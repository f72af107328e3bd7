"""Click and button logs to feedback rows."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from storyrank import constants as K
from storyrank.functions.text import _c


def parse_callbacks(raw: DataFrame, col: str = "data") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of ``fb:signal:kind:id`` strings."""
    parts = F.split(F.coalesce(F.col(col), F.lit("")), ":")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    ok = (
        (F.size(parts) == 4) & (at(1) == "fb") & at(2).isin("up", "down")
        & at(3).isin(*K.TARGET_KINDS) & (at(4) != "")
    )
    marked = raw.withColumn("__ok", F.coalesce(ok, F.lit(False)))
    rest = [c for c in raw.columns if c != col]
    good = marked.filter("__ok").select(
        *rest, at(2).alias("signal"), at(3).alias("target_kind"), at(4).alias("target_id"),
        F.when(at(2) == "up", F.lit(1.0)).otherwise(F.lit(-1.0)).alias("value"),
    )
    return good, marked.filter(~F.col("__ok")).drop("__ok")


def signature(target_id, target_kind, signal, value, secret: str) -> Column:
    """Keyed SHA-256 of the signed fields, first 32 hex digits; empty without a secret."""
    if not secret:
        return F.lit("")
    key = secret.encode("utf-8")

    @pandas_udf("string")
    def sign(message: pd.Series) -> pd.Series:
        return message.map(
            lambda m: None if m is None
            else hmac.new(key, m.encode("utf-8"), hashlib.sha256).hexdigest()[:K.SIGNATURE_CHARS]
        )

    return sign(F.concat_ws("|", *[_c(c).cast("string") for c in (target_id, target_kind, signal, value)]))


def verify_clicks(rows: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """(verified, quarantined) click rows. Without a secret every signature passes; a row
    that is signed rightly but names no known kind or signal is quarantined too."""
    known = (
        F.col("target_kind").isin(*K.TARGET_KINDS) & F.col("signal").isin(*K.SIGNALS)
        & F.col("value").cast("string").try_cast("double").isNotNull() & (F.col("target_id") != "")
    )
    ok = F.coalesce(known, F.lit(False))
    if secret:
        expected = signature("target_id", "target_kind", "signal", "value", secret)
        ok = ok & F.coalesce(F.col("sig") == expected, F.lit(False))
    marked = rows.withColumn("__ok", ok)
    return marked.filter("__ok").drop("__ok"), marked.filter(~F.col("__ok")).drop("__ok")
