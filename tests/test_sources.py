"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from airtrail.checks.tables import SUFFIXES
from airtrail.functions import net, text, times, url
from airtrail.sources import catalog, lines, sinks, tables, traffic, wifi

HEAD = "1420416245000 <13>Jan  5 00:04:05 2015 192.0.2.1 stm[3]: "
AP = "AP 192.0.2.1-02:00:5e:10:00:01-LAB-2F-07"
JAN = 1420416245000


@pytest.mark.parametrize("line,want", [
    (HEAD + f"<501106> <NOTI> |AP x|  Deauth to sta: 02:00:5e:10:00:aa: Ageout {AP} handle", ("02005e1000aa", JAN, 1, "LAB-2F-07", None, None)),
    (HEAD + f"<501091> <NOTI>  Auth request: 02:00:5e:10:00:aa: {AP}", ("02005e1000aa", JAN, 0, "LAB-2F-07", None, None)),
    (HEAD + f"<501113> <NOTI>  Disassoc from sta: 02:00:5e:10:00:aa: {AP}", ("02005e1000aa", JAN, 3, "LAB-2F-07", None, None)),
    (HEAD + "<522008> <NOTI> ok: username=ann MAC=02:00:5e:10:00:aa IP=10.1.2.3 AP=q role", ("02005e1000aa", JAN, 4, None, "ann", "10.1.2.3")),
    (HEAD + "<522005> <INFO> MAC=02:00:5e:10:00:aa IP=10.184.2.3 x", ("02005e1000aa", JAN, 6, None, None, "10.184.2.3")),
    (HEAD + "<500010> <NOTI> Station 02:00:5e:10:00:aa, 10.1.2.3: moved to AP HALL-1, net/02:00:5e:10:00:02/a", ("02005e1000aa", JAN, 7, "HALL-1", None, "10.1.2.3")),
    (HEAD + "<522035> <INFO> MAC=02:00:5e:10:00:aa Station UP: BSSID=02:00:5e:10:00:02 ESSID=net VLAN=1 AP-name=HALL-2", ("02005e1000aa", JAN, 8, "HALL-2", None, None)),
    (HEAD + "<522005> <INFO> MAC=02:00:5e:10:00:aa IP=10.1.2.3 x", None),
    (HEAD + "<404400> other", None), ("no marks", None), (HEAD + f"<501999> Auth request: 02:00:5e:10:00:aa: {AP}", None), (HEAD + "<5x1> y", None),
])
def test_syslog(spark, line, want):
    got = [tuple(r) for r in wifi.parse_wifi_syslog(spark.createDataFrame([(line,)], "value STRING")).collect()]
    assert got == ([] if want is None else [want])


def test_tolerant_gzip_keeps_rows(spark, tmp_path):
    body = gzip.compress(b"\n".join(b"row %d" % i for i in range(1000)) + b"\n")
    (tmp_path / "crc.gz").write_bytes(body[:-8] + b"\0" * 8)
    (tmp_path / "two.gz").write_bytes(gzip.compress(b"x\ny\n") + gzip.compress(b"z"))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(bytes(range(256)).hex().encode() * 3 + b"\nend\n")[:-12])
    def read(name):
        return [r.value for r in lines.read_lines(spark, str(tmp_path / name), tolerant_gzip=True).collect()]

    assert read("crc.gz") == [f"row {i}" for i in range(1000)]
    assert read("two.gz") == ["x", "y", "z"]
    assert read("cut.gz")[0].startswith("000102")


def test_named_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Log1.txt").write_text("a\n")
    (tmp_path / "sub" / "xlog2.txt").write_text("b\n")
    def read(match):
        return sorted(r.value for r in lines.read_lines(spark, str(tmp_path), "log", match).collect())

    assert read(True) == ["a"] and read(False) == ["a", "b"]


def test_http_line(spark):
    row = ('192.0.2.9 4711 198.51.100.4 80 unique 1.5 N/A N/A N/A 1420416246.250001 0.0 N/A N/A N/A N/A 120 640 "GET" "/list?page=2" "HTTP/1.1" "shop.example" "ua "q" x" "N/A" "K" "N/A" '
           '"HTTP/1.1" "200" "n" "N/A" "text/html" "gzip" "N/A" "N/A" "N/A" "N/A" "N/A" "close" "N/A"')
    df = spark.createDataFrame([(row,), ("short",)], "value STRING")
    got = traffic.parse_http(df).collect()
    assert len(got) == 1 and got[0].request_user_agent == "ua q x" and got[0].response_ts is None and got[0].request_ts == 1420416246.250001
    assert traffic.bad_http(df).count() == 1 and [c.count() for c in lines.split_good_bad(df, 1)] == [1, 1]


def test_location_log(spark):
    rows = ["m\t2013-01-01 00:00:00\tIPAllocation\t1.2.3.4", "m\t2013-01-01 00:00:00\t2013-01-01 01:00:00\t3600\tAP1", "m\t2013-01-01 00:00:00 userauth x", ""]
    got = {r.kind: (r.t_ms, r.ip, r.end_ms, r.ap) for r in wifi.parse_location_log(spark.createDataFrame([(r,) for r in rows], "value STRING")).collect()}
    assert got["alloc"] == (1356998400000, "1.2.3.4", None, None) and got["assoc"][2:] == (1357002000000, "AP1") and "auth" in got


def test_catalog_and_lookups(spark, tmp_path):
    (tmp_path / "kv.txt").write_text("1,a\n2,b\n3,c\n")
    catalog.create_table(spark, "kv_test", "key INT, value STRING", str(tmp_path / "t"))
    catalog.load_file(spark, "kv_test", str(tmp_path / "kv.txt"))
    assert catalog.row_count(spark.table("kv_test")).first().n == 3
    assert [tuple(r) for r in catalog.describe(spark, "kv_test").collect()] == [("key", "int"), ("value", "string")]
    spark.sql("DROP TABLE kv_test")
    (tmp_path / "p.csv").write_text("ID\tShort\tCat\n0\tUnknown\tOther\n")
    assert tables.read_lookup(spark, "protocols", str(tmp_path / "p.csv")).first().name == "Unknown"
    (tmp_path / "ap.csv").write_text("B1,Lab,t,u,1.5,2.5\nB2,null,null,null,null,null\n")
    assert [r.code for r in tables.load_ap_table(spark, str(tmp_path / "ap.csv")).collect()] == ["B1"]


def test_month_sets(spark, tmp_path):
    df = spark.createDataFrame([(JAN, 1), (JAN + 40 * times.DAY_MS, 2)], "stime LONG, x INT")
    sinks.write_by_month(df, str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m").iterdir() if p.is_dir()) == ["set=SET1501", "set=SET1502"]


def test_columns(spark):
    row = spark.createDataFrame([("http://www.a.co.uk:80/x?b=1&b=2&c=3", "1.2.3.256", "iPhone android 4")], "u STRING, ip STRING, ua STRING")
    got = row.select(
        url.url_host(F.col("u")).alias("host"), url.registered_domain(F.col("u"), SUFFIXES).alias("dom"), url.url_params(F.col("u")).alias("par"),
        url.strip_url(F.col("u")).alias("bare"), url.mobile_type(F.col("ua")).alias("dev"), url.registered_domain(F.lit("co.uk"), SUFFIXES).alias("whole"),
        url.registered_domain(F.lit("a.b.ck"), url.Suffixes(("com",), ("ck",), ("www.ck",))).alias("wild"), url.has_proto(F.lit(None).cast("string")).alias("none"),
        net.direction(F.lit("10.0.0.1"), F.lit("20.0.0.1"), ["10.0.0.0/8"], ["20.0.0.0/8"]).alias("side"), text.crc32_text(F.lit("abc")).alias("crc"),
        text.f_measure(F.lit(0.5), F.lit(0.5)).alias("f"), times.syslog_ms(F.lit("Jan  1 00:00:00")).alias("y13"), net.long_to_ip(F.lit(16909060)).alias("ip"),
    ).first()
    assert tuple(got) == ("www.a.co.uk", "a.co.uk", {"b": "2", "c": "3"}, "www.a.co.uk:80/x", "android", "co.uk", "a.b.ck", False, "client", 0x352441C2, 0.5, 1356998400000, "1.2.3.4")


def test_faulty_gzip_members(spark, tmp_path):
    """Wrong checksums, cut ends and damaged members, read in steps of any size; whole members around them stay."""
    import gzip
    import io
    import random

    from airtrail.sources import members

    rng = random.Random(4)
    body = [[f"part {p} line {i} {rng.random()}" for i in range(3000)] for p in range(4)]
    packed = [gzip.compress(("\n".join(x) + "\n").encode()) for x in body]
    checksum = packed[0][:-8] + b"12345678" + packed[1]
    cut = packed[0] + packed[1][: len(packed[1]) // 2]
    middle = bytearray(packed[1])
    middle[len(middle) // 2 : len(middle) // 2 + 40] = bytes(40)
    damaged = packed[0] + bytes(middle) + packed[2] + b"\0" * 50 + packed[3]

    def read(data: bytes, step: int) -> list:
        return [line for some in members.lines(members.inflate(io.BytesIO(data).read, step)) for line in some]

    for step in (7_000, 1 << 20):
        assert read(checksum, step) == body[0] + body[1]
        got = read(cut, step)
        assert got[:3000] == body[0] and got[3000:-1] == body[1][: len(got) - 3001] and len(got) > 4000
        got = read(damaged, step)
        assert got[:3000] == body[0] and got[-6000:] == body[2] + body[3] and got[3000:4000] == body[1][:1000]
        assert read(b"", step) == [] and read(b"no gzip at all" * 9, step) == []
    for name, data in (("a.gz", checksum), ("b.gz", damaged), ("c.gz", cut)):
        (tmp_path / name).write_bytes(data)
    got = {r.value for r in lines.read_lines(spark, str(tmp_path), r".*\.gz", tolerant_gzip=True).collect()}
    assert got >= {line for part in body for line in (part if part is not body[1] else part[:1000])}
