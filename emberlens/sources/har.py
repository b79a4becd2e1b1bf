"""HTTP archives: entries joined to a reviewed sidecar by place, without headers or bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRIES = "log STRUCT<entries: ARRAY<STRUCT<startedDateTime: STRING, time: DOUBLE, request: STRUCT<method: STRING, url: STRING>, response: STRUCT<status: INT, content: STRUCT<size: BIGINT, mimeType: STRING>>>>>"
SIDECAR = "ARRAY<STRUCT<operation: STRING, request_group: STRING>>"
# Query keys that carry credentials.
CREDENTIALS = "(?i)[?&](token|access_token|api_key|apikey|key|password|secret|signature|x-amz-signature)="


def requests(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """capture, n, method, url, status, n_bytes, millis, operation and request_group; and captures refused, with a reason. raw: capture, har, sidecar."""
    parsed = raw.select("capture", F.from_json("har", ENTRIES)["log"]["entries"].alias("e"), F.from_json("sidecar", SIDECAR).alias("s"))
    secret = F.exists("e", lambda x: x["request"]["url"].rlike(CREDENTIALS) | x["request"]["url"].rlike("^[a-z]+://[^/]*@"))
    reason = F.when(F.col("e").isNull(), "no entries").when(F.col("s").isNull() | (F.size("e") != F.size("s")), "sidecar does not match").when(secret, "credentials in a URL")
    judged = parsed.withColumn("reason", reason)
    rows = judged.where("reason IS NULL").select("capture", F.posexplode(F.arrays_zip("e", "s")).alias("n", "x"))
    e, s = F.col("x")["e"], F.col("x")["s"]
    out = rows.select("capture", "n", e["request"]["method"].alias("method"), F.regexp_replace(e["request"]["url"], "[?#].*$", "").alias("url"), e["response"]["status"].alias("status"), e["response"]["content"]["size"].alias("n_bytes"), e["time"].alias("millis"), s["operation"].alias("operation"), s["request_group"].alias("request_group"))
    return out, judged.where("reason IS NOT NULL").select("capture", "reason")
