"""Statuses of requests, against the rules one by one."""

from urllib.parse import unquote

from pyspark.sql import functions as F

from tidelog.operators import http

KEYS = ["a", "b/c", "ä", "k" * 4096]
TARGETS = [
    *(f"/v1/kv/{k}" for k in ("a", "b%2Fc", "%C3%A4", "k" * 4096, "none", "a?x=1", "", "?a", "a%ZZ", "k" * 4097, "%")),
    "/healthz", "/healthz?probe=1", "/admin/stats", "/admin/flush", "/admin/compact", "/v1/kv", "/", "", None,
]
VERBS = ["GET", "PUT", "DELETE", "POST", "PATCH", None]


def want(verb, target, large):
    path = (target or "").split("?")[0]
    if path.startswith("/v1/kv/"):
        key = path.removeprefix("/v1/kv/")
        bad = any(len(x) < 2 or not set(x[:2]) <= set("0123456789abcdefABCDEF") for x in key.split("%")[1:])
        if bad or not 0 < len(unquote(key).encode()) <= 4096:
            return 400
        if verb not in ("GET", "PUT", "DELETE"):
            return 405
        return (413 if large and verb == "PUT" else 204) if verb != "GET" else 200 if unquote(key) in KEYS else 404
    return 404 if path not in http.ADMIN else http.DONE[path] if verb == http.ADMIN[path] else 405


def test_statuses(spark):
    cases = [(v, t, b) for v in VERBS for t in TARGETS for b in (False, True)]
    requests = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id long, method string, target string, body_too_large boolean")
    df = http.status(requests, spark.createDataFrame([(k,) for k in KEYS], "key string"))
    assert {r.id: r.status for r in df.collect()} == {i: want(*c) for i, c in enumerate(cases)}


def test_requests_without_a_lookup_do_not_gather(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for target in ("/v1/kv/" + "k" * 4097, "/v1/kv/", "/v1/kv/%", "/healthz"):
            requests = spark.range(2000).select("id", F.lit("GET").alias("method"), F.when(F.col("id") >= 0, target).alias("target"), F.lit(False).alias("body_too_large"))
            df = http.status(requests, spark.createDataFrame([(k,) for k in KEYS], "key string"))
            tasks = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(tasks) == 2000 and max(tasks) < 1000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
