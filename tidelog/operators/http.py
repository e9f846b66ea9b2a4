"""Request classification of the key-value service."""

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.functions import percent_decode, strip_query
from tidelog.schema import MAX_KEY_LEN

PREFIX = "/v1/kv/"
ASKS = 0  # no status yet: the live keys decide
ADMIN = {"/healthz": "GET", "/admin/stats": "GET", "/admin/flush": "POST", "/admin/compact": "POST"}
DONE = {"/healthz": 200, "/admin/stats": 200, "/admin/flush": 204, "/admin/compact": 204}


def method(c: Column) -> Column:
    return F.when(c.isin("GET", "PUT", "DELETE", "POST"), c).otherwise("OTHER")


def status(requests: DataFrame, live: DataFrame) -> DataFrame:
    """The status of each (id, method, target, body_too_large) against the live keys: keys are validated before methods.

    Only a valid GET of a key asks the live keys. All other requests leave their key behind and are
    dealt over the join's tasks by their id, so that neither empty, malformed and overlong keys nor
    other paths gather in one task."""
    path, verb = strip_query(F.col("target")), method(F.col("method"))
    is_kv = path.startswith(PREFIX)
    raw = F.substring(path, len(PREFIX) + 1, 1 << 30)
    parsed = requests.select("id", verb.alias("verb"), path.alias("path"), is_kv.alias("is_kv"), F.when(is_kv, percent_decode(raw)).alias("key"), "body_too_large")
    out = F.when(F.col("is_kv") & (F.col("key").isNull() | (F.octet_length("key") == 0) | (F.octet_length("key") > MAX_KEY_LEN)), 400)
    out = out.when(F.col("is_kv") & ~F.col("verb").isin("GET", "PUT", "DELETE"), 405)
    out = out.when(F.col("is_kv") & (F.col("verb") == "PUT") & F.col("body_too_large"), 413)
    out = out.when(F.col("is_kv") & F.col("verb").isin("PUT", "DELETE"), 204)
    out = out.when(F.col("is_kv"), ASKS)
    for p, v in ADMIN.items():
        out = out.when(F.col("path") == p, F.when(F.col("verb") == v, DONE[p]).otherwise(405))
    judged = parsed.select("id", "key", out.otherwise(404).cast("int").alias("status"))
    asks = F.col("status") == ASKS
    # one name for both, as a constant beside the key would leave the join by the optimizer's hand
    name = F.when(asks, F.concat(F.lit("k"), "key")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string")))
    found = judged.select("id", "status", name.alias("name")).join(live.select(F.concat(F.lit("k"), "key").alias("name"), F.lit(True).alias("found")), "name", "left")
    return found.select("id", F.when(~asks, F.col("status")).when(F.col("found"), 200).otherwise(404).cast("int").alias("status"))


def error_status(kind: Column) -> Column:
    """The status of an engine's failure by its name."""
    return F.when(kind == "OutOfMemory", 503).when(kind == "KeyTooLong", 400).otherwise(500)
