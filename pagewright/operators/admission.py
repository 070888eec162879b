"""URL admission: syntax, then addresses. Errors are row values; no row fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import arrow
from pagewright.functions import scalars as S

MAX_URL = 2048
# Error codes with their HTTP status.
STATUS = {
    "invalid_url": 422, "blocked_address": 400, "blocked_by_robots": 403, "fetch_failed": 502, "fetch_timeout": 504,
    "page_too_large": 422, "not_html": 422, "unauthorized": 401, "extract_error": 500, "invalid_request": 422,
}
ERROR = "struct<code:string,http_status:int,message:string>"


def error(code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), F.lit(STATUS[code]).alias("http_status"), text.alias("message")).cast(ERROR)


def request_error(url: Column) -> Column:
    """Shape of a request: an address of 1 to 2048 characters."""
    return F.when(url.isNull() | ~F.length(url).between(1, MAX_URL), error("invalid_request", "url must have 1 to 2048 characters"))


def syntax_problem(url: Column) -> Column:
    """Why an address can't be used; null if it can. The first reason counts."""
    u = F.trim(url)
    p = S.url_parts(u)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = p["host"]
    bad_port = (p["port"] != "") & ~(p["port"].rlike("^[0-9]{1,5}$") & (p["port"].try_cast("int") <= 65535))
    bracketed = F.regexp_extract(u, r"^[^/]*://([^/?#]*)", 1)
    malformed = bad_port | (bracketed.contains("[") != bracketed.contains("]"))
    return (
        F.when(u.isNull() | (u == ""), F.lit("URL must not be empty."))
        .when(F.length(u) > MAX_URL, F.lit(f"URL is longer than {MAX_URL} characters."))
        .when(u.rlike(r"[\x00-\x20\x7f]"), F.lit("URL must not contain spaces or control characters."))
        .when(malformed, F.lit("URL is malformed."))
        .when(~scheme.isin("http", "https"), F.concat(F.lit("Only http and https URLs are supported (got '"), F.when(scheme == "", F.lit("none")).otherwise(scheme), F.lit("').")))
        .when(u.rlike("^[^/]*://[^/?#]*@"), F.lit("URLs with embedded credentials are not allowed."))
        .when(host == "", F.lit("URL has no host."))
    )


def target_of(url: Column) -> dict[str, Column]:
    p = S.url_parts(F.trim(url))
    host = F.regexp_replace(F.regexp_replace(p["host"], r"[\[\]]", ""), r"\.+$", "")
    default = F.when(p["scheme"] == "https", 443).otherwise(80)
    port = F.coalesce(F.when(p["port"] != "0", p["port"].try_cast("int")), default)
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    header = F.when(port != default, F.concat(shown, F.lit(":"), port.cast("string"))).otherwise(shown)
    path = F.concat(F.when(p["path"] == "", F.lit("/")).otherwise(p["path"]), F.when(p["query"] == "?", F.lit("")).otherwise(p["query"]))
    return {"scheme": p["scheme"], "host": host, "port": port, "host_header": header, "path": path}


def admit(urls: DataFrame, dns: DataFrame, url: str = "url", allow_private: bool = False) -> DataFrame:
    """urls with error, and scheme, host, port, ip, host_header, path of the admitted ones. dns(host, ips array<string>).

    Literal addresses stand for themselves. All addresses of a host must be public."""
    t = target_of(F.col(url))
    df = urls.withColumns({"problem": syntax_problem(F.col(url)), **t})
    names = dns.select(F.col("host").alias("dns_host"), "ips")
    df = df.join(names, df.host == names.dns_host, "left")
    literal = F.col("host").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | F.col("host").contains(":")
    df = df.withColumn("ips", F.when(literal, F.array("host")).otherwise(F.col("ips")))
    # Addresses follow from the host alone: each host is judged once, whatever the number of its urls.
    listed = df.where("problem is null").select("host", F.posexplode("ips").alias("pos", "ip")).distinct()
    public = listed.select("ip").distinct().withColumn("public", arrow.is_public_ip_udf("ip"))
    bad = listed.join(public, "ip", "left").where("not coalesce(public, false)").groupBy(F.col("host").alias("bad_host")).agg(F.min_by("ip", "pos").alias("bad_ip"))
    out = df.join(bad, (df.host == bad.bad_host) & df.problem.isNull(), "left")
    blocked = F.concat(F.lit("Host '"), F.col("host"), F.lit("' resolves to a non-public address ("), F.col("bad_ip"), F.lit(")."))
    err = (
        F.when(F.col("problem").isNotNull(), error("invalid_url", F.col("problem")))
        .when(F.col("ips").isNull() | (F.size("ips") == 0), error("invalid_url", F.concat(F.lit("Could not resolve host '"), F.col("host"), F.lit("'."))))
        .when(F.col("bad_ip").isNotNull() & F.lit(not allow_private), error("blocked_address", blocked))
    )
    ok = err.isNull()
    own = [F.when(ok, F.col(c)).alias(c) for c in ("scheme", "host", "port", "host_header", "path")]
    return out.select(*urls.columns, err.alias("error"), *own, F.when(ok, F.get("ips", F.lit(0))).alias("ip"))


def public_ipv4(ip: Column) -> Column:
    """Whether a dotted IPv4 address is globally reachable, as range comparisons in the JVM."""
    parts = F.split(ip, r"\.")
    number = sum((F.get(parts, F.lit(i)).try_cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("bigint"))
    inside = F.lit(False)
    for net in NOT_PUBLIC_IPV4:
        base, bits = net.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        inside = inside | number.between(low, low + (1 << (32 - int(bits))) - 1)
    for single in PUBLIC_IPV4:
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(single.split(".")))
        inside = inside & (number != low)
    return ~inside


# IPv4 blocks that aren't globally reachable (IANA special-purpose registry; multicast), and exceptions.
NOT_PUBLIC_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_IPV4 = ("192.0.0.9", "192.0.0.10")
