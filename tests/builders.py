"""Small tables and capture bytes for the tests."""
import struct

from floodlens.schemas import PACKETS

V, A, C = "10.0.0.100", "10.0.0.21", "10.0.0.11"
SYN, ACK = 2, 16


def packet(ts, src, dst, proto=6, size=40, flags=0, sport=1000, dport=80, payload=0):
    return (int(round(ts * 1e6)), src, dst, proto, size, payload, sport, dport, flags)


def packet_table(spark, rows, session="t1"):
    """Rows get arrival numbers in the order given."""
    return spark.createDataFrame([(session, i, *r) for i, r in enumerate(rows)], PACKETS)


def ipv4(src, dst, proto, l4, size=None, frag=0):
    total = 20 + len(l4) if size is None else size
    address = lambda a: bytes(int(p) for p in a.split("."))
    return struct.pack("!BBHHHBBH", 0x45, 0, total, 0, frag, 64, proto, 0) + address(src) + address(dst) + l4


def tcp(sport, dport, flags, payload=b""):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload


def udp(sport, dport, payload=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) + payload


def icmp(payload=b""):
    return struct.pack("!BBHI", 8, 0, 0, 0) + payload


def ethernet(body, kind=0x0800, vlans=()):
    tags = b"".join(struct.pack("!HH", 0x8100, v) for v in vlans)
    return b"\0" * 12 + tags + struct.pack("!H", kind) + body


def pcap(records, order="<", magic=0xA1B2C3D4, linktype=1, cut=0):
    """records: (seconds, fraction, data)."""
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for s, f, data in records:
        out += struct.pack(order + "IIII", s, f, len(data), len(data)) + data
    return out[:len(out) - cut] if cut else out


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    n = len(body) + 12
    return struct.pack(order + "II", kind, n) + body + struct.pack(order + "I", n)


def pcapng(records, order="<", units=1_000_000, tsresol=None, linktype=1):
    """records: (time in units, data)."""
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1), order)
    options = b"" if tsresol is None else struct.pack(order + "HHB3x", 9, 1, tsresol) + struct.pack(order + "HH", 0, 0)
    out += block(1, struct.pack(order + "HHI", linktype, 0, 65535) + options, order)
    for t, data in records:
        out += block(6, struct.pack(order + "5I", 0, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data, order)
        out += block(3, struct.pack(order + "I", len(data)) + data, order)     # simple packet: no time, skipped
    return out


def packets_df(spark, rows):
    """Packets with their own sessions and arrival numbers."""
    return spark.createDataFrame(rows, PACKETS)
