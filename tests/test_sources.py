"""Fetching from an archive, and the streaming forms."""

import datetime as dt

from pyspark.sql import functions as F

from pagewright.config import EngineConfig
from pagewright.sources.fetch import fetch, read_folder
from pagewright.streaming import keyed


def test_fetch(spark):
    host = "https://a.test"
    archive = spark.createDataFrame(
        [
            (f"{host}/ok", 200, None, "text/html; charset=latin-1", "<h1>é</h1>".encode("latin-1")), (f"{host}/moved", 302, "/ok", None, b""), (f"{host}/loop", 301, "/loop", None, b""),
            (f"{host}/gone", 404, None, "text/html", b"x"), (f"{host}/pdf", 200, None, "application/pdf", b"x"), (f"{host}/big", 200, None, "text/html", b"x" * 200), (f"{host}/inside", 302, "http://10.0.0.1/", None, b""), (f"{host}/untyped", 200, None, None, b"hi"),
        ],
        "url string, status int, location string, content_type string, body binary",
    )
    dns = spark.createDataFrame([("a.test", ["93.184.216.34"])], "host string, ips array<string>")
    rules = spark.createDataFrame([(host, 200, "User-agent: *\nDisallow: /no")], "origin string, status int, text string")
    names = ["ok", "moved", "loop", "gone", "pdf", "big", "inside", "untyped", "missing", "no/way"]
    urls = spark.createDataFrame([(f"{host}/{n}",) for n in names] + [("ftp://x",), ("https://unknown.test/",)], "url string")
    got = {r.url.replace(f"{host}/", ""): (r.error.code if r.error else None, r.html) for r in fetch(urls, archive, dns, rules, EngineConfig(max_page_bytes=100, max_redirects=2)).collect()}
    assert got["ok"] == (None, "<h1>é</h1>") == got["moved"] and got["untyped"] == (None, "hi")
    codes = {n: c for n, (c, _) in got.items() if c}
    assert codes == {"loop": "fetch_failed", "gone": "fetch_failed", "pdf": "not_html", "big": "page_too_large", "inside": "blocked_address", "missing": "fetch_failed", "no/way": "blocked_by_robots", "ftp://x": "invalid_url", "https://unknown.test/": "invalid_url"}


def test_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>x</h1>\n<p>y")
    row = read_folder(spark, str(tmp_path), "https://b.test/").first()
    assert (row.url, row.html) == ("https://b.test/a.html", "<h1>x</h1>\n<p>y")


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "h" if i % 2 else "g", start + dt.timedelta(seconds=i * 0.25), True) for i in range(12)]
    spark.createDataFrame(rows, "id long, host string, arrival timestamp, ok boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, host string, arrival timestamp, ok boolean").parquet(str(tmp_path / "in"))

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    got = {r.id: r.start for r in run(keyed.paced_stream(stream), "paced")}
    epoch = start.replace(tzinfo=dt.timezone.utc).timestamp()
    last = {}
    for i, h, at, _ in rows:
        now = epoch + i * 0.25
        last[h] = max(now, last[h] + 1.0) if h in last else now
        assert abs(got[i] - last[h]) < 1e-6
    hits = {r.id: r.hit for r in run(keyed.ttl_cache_stream(stream.select("id", F.col("host").alias("key"), F.col("arrival").alias("at"), "ok"), ttl=1.0), "cached")}
    assert [hits[i] for i in range(0, 12, 2)] == [False, True, True, False, True, True]
