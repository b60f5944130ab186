"""Client keys and the known-key gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdlp.config import GuardConfig
from sparkdlp.functions.text import strip


def client_key(auth_header: Column, x_api_key: Column) -> Column:
    """Bearer token if there is one, else the API-key header, else empty."""
    bearer = F.lower(auth_header).startswith("bearer ")
    return F.when(
        F.coalesce(bearer, F.lit(False)), strip(F.substring(auth_header, 8, 2**31 - 1))
    ).otherwise(F.coalesce(x_api_key, F.lit("")))


def rate_key(key: Column, host: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), host, F.lit("unknown"))


def known_keys(spark: SparkSession, cfg: GuardConfig) -> DataFrame:
    """The configured keys as a table small enough to plan with."""
    keys = F.array(*(F.lit(k) for k in cfg.known_keys)).cast("array<string>")
    return spark.range(1).select(F.explode(keys).alias("client_key"))


def _usable(keys: DataFrame) -> DataFrame:
    return keys.where(F.col("client_key") != "").select("client_key").distinct()


def auth_accept(requests: DataFrame, keys: DataFrame, required: bool = True) -> DataFrame:
    """Requests with a known key.  Spark picks the join by the size of ``keys``."""
    if not required:
        return requests
    return requests.join(_usable(keys), "client_key", "left_semi")


def auth_reject(requests: DataFrame, keys: DataFrame, required: bool = True) -> DataFrame:
    """Requests without a key or with an unknown one."""
    if not required:
        return requests.where(F.lit(False))
    return requests.join(_usable(keys), "client_key", "left_anti")


def with_auth(requests: DataFrame, keys: DataFrame, required: bool = True) -> DataFrame:
    """``auth_ok`` for every request."""
    if not required:
        return requests.withColumn("auth_ok", F.lit(True))
    known = _usable(keys).withColumn("auth_ok", F.lit(True))
    return requests.join(known, "client_key", "left").withColumn(
        "auth_ok", F.coalesce("auth_ok", F.lit(False))
    )
