"""Queries over captures: frames are built from the derived packets, so decoding must give them back."""
import functools

from pyspark.sql import functions as F

from floodlens.operators.peer_windows import peer_windows
from floodlens.plans.packet_view import (DIR_SQL, SERVER, WINDOWS_OUT_SQL, packets, pk_sql, table, win_sql, windows_out)
from floodlens.plans.registry import query
from floodlens.session import shared_dir
from floodlens.sources import capture as C

FRAMES_PER_FILE = 2500
SLICE_HOST = "10.0.0.12"


def hex_of(value, digits):
    return F.lpad(F.hex(value.cast("bigint")), digits, "0")


def frames(spark, sf):
    """Ethernet frames cut to their headers; one in four carries a VLAN tag, one in nineteen is ARP."""
    p = packets(spark, sf)
    address = lambda c: F.concat(*[hex_of(F.split(c, r"\.")[i], 2) for i in range(4)])
    ip = F.concat(F.lit("4500"), hex_of(F.col("size"), 4), F.lit("0000000040"), hex_of(F.col("proto"), 2),
                  F.lit("0000"), address("src"), address("dst"))
    ports = F.concat(hex_of(F.col("sport"), 4), hex_of(F.col("dport"), 4))
    l4 = (F.when(F.col("proto") == 6, F.concat(ports, F.lit("000000000000000050"), hex_of(F.col("flags"), 2), F.lit("000000000000")))
          .when(F.col("proto") == 17, F.concat(ports, F.lit("00000000"))).otherwise(F.lit("0800000000000000")))
    tag = F.when(F.col("seq") % 4 == 0, F.lit("810000050800")).otherwise(F.lit("0800"))
    mac = F.lit("00" * 12)
    body = F.when(F.col("seq") % 19 == 18, F.concat(mac, F.lit("0806"), F.lit("00" * 28))).otherwise(F.concat(mac, tag, ip, l4))
    file_idx = F.floor(F.col("seq") / FRAMES_PER_FILE).cast("int")
    return p.select("session", file_idx.alias("file_idx"), (F.col("seq") % FRAMES_PER_FILE).alias("frame_seq"),
                    F.lit(1).alias("linktype"), "ts_us", (F.col("size") + 14).cast("int").alias("origlen"),
                    F.unhex(body).alias("data"))


FR_SQL = f"""WITH RECURSIVE {pk_sql()},
fr AS (SELECT *, seq % 19 = 18 AS arp, seq // {FRAMES_PER_FILE} AS file_idx, seq % {FRAMES_PER_FILE} AS frame_seq,
  CASE WHEN proto = 6 THEN payload ELSE payload + 12 END AS pay FROM pk)"""
DECODED_SQL = f"""{FR_SQL} SELECT session, CAST(file_idx * 1099511627776 + frame_seq AS BIGINT) AS seq, CAST(ts_us AS BIGINT) AS ts_us, src, dst,
  CAST(proto AS INT) AS proto, CAST(size AS INT) AS size, CAST(pay AS INT) AS payload, CAST(sport AS INT) AS sport,
  CAST(dport AS INT) AS dport, CAST(flags AS INT) AS flags FROM fr WHERE NOT arp"""


@query("packet_decode", DECODED_SQL)
def q_decode(spark, sf):
    return C.decode(frames(spark, sf))


@functools.lru_cache(maxsize=8)
def captured(spark, sf):
    """The frames written once as capture files in the shared folder; later queries read the same files."""
    folder = shared_dir(spark, "captures")
    C.write_captures(frames(spark, sf), folder).count()
    return folder


@query("capture_scan", f"""{FR_SQL} SELECT CAST(file_idx AS INT) AS file_idx, CAST(count(*) AS BIGINT) AS frames,
  CAST(sum(ts_us) AS BIGINT) AS ts_sum, CAST(sum(size + 14) AS BIGINT) AS bytes, CAST(max(frame_seq) AS BIGINT) AS last_frame
FROM fr GROUP BY file_idx""")
def q_capture_scan(spark, sf):
    f = C.read_captures(spark, [captured(spark, sf)], "s1")
    return f.groupBy("file_idx").agg(F.count("*").alias("frames"), F.sum("ts_us").alias("ts_sum"),
                                     F.sum("origlen").alias("bytes"), F.max("frame_seq").alias("last_frame"))


@query("capture_decode", DECODED_SQL)
def q_capture_decode(spark, sf):
    return C.decode(C.read_captures(spark, [captured(spark, sf)], "s1"))


@query("capture_windows", f"""{FR_SQL},
dirp AS (SELECT session, seq, ts_us, src, dst, proto, size, pay AS payload, sport, dport, flags,
  dst = '{SERVER}' AS inb, CASE WHEN dst = '{SERVER}' THEN src ELSE dst END AS peer FROM fr WHERE NOT arp), {win_sql()}
SELECT {WINDOWS_OUT_SQL} FROM win""")
def q_capture_windows(spark, sf):
    """From capture files to features: scan, decode, aggregate."""
    return windows_out(peer_windows(C.decode(C.read_captures(spark, [captured(spark, sf)], "s1")), [SERVER]))


HOST_SQL = f"NOT arp AND (src = '{SLICE_HOST}' OR dst = '{SLICE_HOST}')"


@query("host_slice", f"""{FR_SQL} SELECT CAST(file_idx AS INT) AS file_idx, CAST(frame_seq AS BIGINT) AS frame_seq,
  CAST(size + 14 AS INT) AS origlen FROM fr WHERE {HOST_SQL}""")
def q_host_slice(spark, sf):
    return C.host_slice(frames(spark, sf), [SLICE_HOST]).select("file_idx", "frame_seq", "origlen")


@query("host_slice_scan", f"""{FR_SQL} SELECT CAST(file_idx AS INT) AS file_idx, CAST(frame_seq AS BIGINT) AS frame_seq,
  CAST(size + 14 AS INT) AS origlen FROM fr WHERE {HOST_SQL}""")
def q_host_slice_scan(spark, sf):
    """The same with the host filter inside the scan."""
    return C.read_captures(spark, [captured(spark, sf)], "s1", hosts=[SLICE_HOST]).select("file_idx", "frame_seq", "origlen")


@query("slice_sink", f"""{FR_SQL}
SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER ({HOST_SQL}) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS other_link,
  CAST(count(*) FILTER ({HOST_SQL}) AS BIGINT) AS stored, CAST(sum(size + 14) FILTER ({HOST_SQL}) AS BIGINT) AS stored_origlen,
  CAST(max(CASE WHEN {HOST_SQL} THEN (CASE WHEN seq % 4 = 0 THEN 18 ELSE 14 END) + 20
    + CASE proto WHEN 6 THEN 20 ELSE 8 END END) AS INT) AS longest FROM fr""")
def q_slice_sink(spark, sf):
    f = frames(spark, sf)
    path = shared_dir(spark, "slice")
    C.write_slice(f, [SLICE_HOST], path)
    stored = spark.read.parquet(path).agg(
        F.count("*").alias("stored"), F.sum("origlen").alias("stored_origlen"), F.max(F.length("data")).alias("longest"))
    counts = C.slice_counts(f, [SLICE_HOST])
    return counts.withColumn("_1", F.lit(1)).join(stored.withColumn("_1", F.lit(1)), "_1").drop("_1")


@query("capture_order", r"""SELECT p_partkey, replace(p_name, ' ', '_') || '_' || p_partkey || '.pcap' AS name,
  array_to_string(list_transform(regexp_extract_all(replace(p_name, ' ', '_') || '_' || p_partkey || '.pcap', '\d+|\D+'),
    lambda t: CASE WHEN regexp_matches(t, '^\d') THEN lpad(t, 20, '0') ELSE t END), '') AS sort_key FROM part""")
def q_capture_order(spark, sf):
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".pcap"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name")).withColumn("sort_key", C.natural_order(F.col("name")))


__all__ = ["DIR_SQL"]
