"""Vectors of the scalar functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical as cj
from tidemark.functions import times, web


def test_canonical_json(spark):
    rows = spark.sql("""SELECT named_struct('b', 1.5D, 'a', 'x"\\n\\u0001é', 'n', CAST(NULL AS STRING), 'l', array(1.0D, 1e21D, 1e-7D, -0.0D, -2.5e-5D, 333333333.3333332D), 'm', map('z', true, 'a', false)) AS s""")
    got = rows.select(cj.canonical(F.col("s"), rows.schema["s"].dataType).alias("t")).first()["t"]
    assert got == '{"a":"x\\"\\n\\u0001é","b":1.5,"l":[1,1e+21,1e-7,0,-0.000025,333333333.3333332],"m":{"a":false,"z":true},"n":null}'
    with pytest.raises(Exception, match="NaN"):
        spark.sql("SELECT double('NaN') AS d").select(cj.canonical(F.col("d"), spark.sql("SELECT 1D AS d").schema["d"].dataType)).collect()


def test_numbers_as_ecmascript_writes_them(spark):
    want = {4.5: "4.5", 2e-3: "0.002", 1e-27: "1e-27", 5e-324: "5e-324", 1.7976931348623157e308: "1.7976931348623157e+308", 123456789012345680000.0: "123456789012345680000", -1.5e300: "-1.5e+300"}
    df = spark.createDataFrame([(x,) for x in want], "d double")
    assert {r["d"]: r["t"] for r in df.select("d", cj.double_text(F.col("d")).alias("t")).collect()} == want


def test_event_id_escapes_parts(spark):
    parts = [F.lit(x) for x in ("urn", "", "a|b", "c\\d", 1, "created")]
    got = spark.range(1).select(cj.event_id(*parts).alias("i"), cj.event_id_material(*parts).alias("m")).first()
    assert got["m"] == "tidemark|v1|urn||a\\|b|c\\\\d|1|created"
    assert got["i"] == hashlib.sha256(got["m"].encode()).hexdigest()


def test_durations_and_timestamps():
    assert [times.parse_duration(x) for x in (250, "5s", "1.5m", "6h", "1d")] == [250, 5000, 90_000, 21_600_000, 86_400_000]
    assert [times.format_duration(x) for x in (0, 5000, 90_000, 86_400_000, 1)] == ["0s", "5s", "90s", "1d", "1ms"]
    for bad in (-1, "5", "x", float("nan")):
        with pytest.raises(Exception):
            times.parse_duration(bad)
    assert times.parse_timestamp("2026-01-01T00:00:00Z") == 1_767_225_600_000 and times.parse_timestamp("now") is None


def test_web_values():
    assert web.parse_rate_limit({"RateLimit": '"default";r=5;t=30', "RateLimit-Policy": '"default";q=100;w=60'}, 0) == {"limit": 100.0, "remaining": 5.0, "reset_at": 30_000, "policy": "default", "source": "ietf"}
    assert web.parse_rate_limit({"X-RateLimit-Remaining": "1"}, 0)["source"] == "vendor"
    assert web.parse_rate_limit({}, 0) is None
    assert web.parse_problem("application/problem+json", '{"title":"t","status":"404","x":1}') == {"title": "t", "status": 404, "x": 1}
    assert web.parse_problem("text/html", "{}") is None
    assert web.request_url("https://a/b", {"x": None, "y": [1, 2], "z": True}) == "https://a/b?y=1&y=2&z=true"
    s = web.sign("whsec_c2VjcmV0", "m", "100", "body")
    assert web.verify("whsec_c2VjcmV0", "m", "100", "body", f"v1,bad {s}", 100_000)
    assert not web.verify("whsec_c2VjcmV0", "m", "100", "body", s, 500_000)
    assert web.redact_headers({"Cookie": "a", "Accept": "b"}) == {"Cookie": "***", "Accept": "b"}
