"""Which urls may be fetched: their host, an allow-list, and every address that the host resolves to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexoria.functions.addresses import host_parts, ipv4, ipv6, not_public
from lexoria.functions.text import host_allowed


def check_destinations(urls: DataFrame, resolved: DataFrame, allowed: list[str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, port, verdict) of every url.

    resolved: (host, address), what a resolver answered; a numeric host is its own address. Verdicts,
    the first that applies: invalid_url, credentials, no_host, not_allowed (by ``allowed``, empty for
    all), unresolved, invalid_address, blocked (any address is not public), ok. Hosts without answers
    fail, and so do null urls. Addresses are judged once a host.
    """
    parts = urls.select(F.col(id_col), F.explode(F.array(host_parts(F.col(url_col)))).alias("p")).select(id_col, "p.*")
    answers = resolved.filter("host IS NOT NULL").select("host", not_public(F.regexp_replace("address", "%.*$", "")).alias("closed"))
    by_host = answers.groupBy("host").agg(F.bool_or(F.col("closed").isNull()).alias("bad"), F.bool_or("closed").alias("closed"))
    own = F.coalesce(ipv4(F.col("host")).isNotNull() | ipv6(F.col("host")).isNotNull(), F.lit(False))
    hosts = parts.filter("host IS NOT NULL").select("host").distinct().select("host", own.alias("own"), not_public(F.col("host")).alias("own_closed"))
    judged = hosts.join(by_host, "host", "left").select(
        F.col("host").alias("of"),
        F.when(~host_allowed(F.col("host"), allowed or []), "not_allowed").when(F.col("own"), F.when(F.col("own_closed"), "blocked").otherwise("ok")).when(F.col("bad").isNull(), "unresolved")
        .when(F.col("bad"), "invalid_address").when(F.col("closed"), "blocked").otherwise("ok").alias("judged"),
    )
    out = parts.join(judged, F.col("host") == F.col("of"), "left")
    return out.select(id_col, "host", "port", F.coalesce("problem", "judged").alias("verdict"))
