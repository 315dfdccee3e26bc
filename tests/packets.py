"""Frames and capture files for tests."""

import struct

MAC_A, MAC_B = bytes.fromhex("001122334455"), bytes.fromhex("66778899aabb")


def eth(kind, payload, dst=MAC_A, src=MAC_B):
    return dst + src + struct.pack(">H", kind) + payload


def ip4(payload, proto=17, src="192.0.2.1", dst="198.51.100.2", options=b"", frag=0x4000, total=None):
    import ipaddress

    ihl = 5 + len(options) // 4
    size = ihl * 4 + len(payload) if total is None else total
    return struct.pack(">BBHHHBBHII", 0x40 | ihl, 0x10, size, 0x1234, frag, 64, proto, 0, int(ipaddress.ip_address(src)), int(ipaddress.ip_address(dst))) + options + payload


def ip6(payload, follow=17, src="2001:db8::1", dst="2001:db8::2"):
    import ipaddress

    return struct.pack(">IHBB", 6 << 28 | 7 << 20 | 99, len(payload), follow, 64) + ipaddress.ip_address(src).packed + ipaddress.ip_address(dst).packed + payload


def udp(payload, src=9000, dst=9001):
    return struct.pack(">HHHH", src, dst, 8 + len(payload), 0x1111) + payload


def tcp(payload, src=1234, dst=80, flags=0x18, options=b"", seq=1, ack=2):
    return struct.pack(">HHIIHHHH", src, dst, seq, ack, (5 + len(options) // 4) << 12 | flags, 512, 0xABCD, 0) + options + payload


def dns(name=b"\x03www\x07example\x00", answers=()):
    out = struct.pack(">HHHHHH", 0x4242, 0x8180, 1, len(answers), 0, 0) + name + struct.pack(">HH", 1, 1)
    for kind, data in answers:
        out += b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 300, len(data)) + data
    return out


def arp(op=1):
    return struct.pack(">HHBBH", 1, 0x0800, 6, 4, op) + MAC_A + bytes([10, 0, 0, 1]) + MAC_B + bytes([10, 0, 0, 2])


def pcap(records, magic="<", nano=False, linktype=1, snaplen=65535):
    """records: (ns, frame) or (ns, frame, original length)."""
    out = struct.pack(magic + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, linktype)
    for ns, frame, *orig in records:
        out += struct.pack(magic + "IIII", ns // 10**9, ns % 10**9 // (1 if nano else 1000), len(frame), orig[0] if orig else len(frame)) + frame
    return out


def pcapng(records, linktype=1, tsresol=9):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack("<HHI", linktype, 0, 65535) + struct.pack("<HHB3x", 9, 1, tsresol) + struct.pack("<HH", 0, 0))
    for ns, frame in records:
        ticks = ns // 10 ** (9 - tsresol)
        out += block(6, struct.pack("<IIIII", 0, ticks >> 32, ticks & 0xFFFFFFFF, len(frame), len(frame)) + frame)
    return out


def http_flow(start=1_700_000_000_000_000_000, client="10.0.0.1", server="93.184.216.34", port=40000):
    step, out = 1_000_000, []

    def add(forward, flags, payload=b""):
        a, b, s, d = (client, server, port, 80) if forward else (server, client, 80, port)
        out.append((start + len(out) * step, eth(0x0800, ip4(tcp(payload, s, d, flags), 6, a, b))))

    add(True, 2)
    add(False, 18)
    add(True, 16)
    add(True, 24, b"GET /index.html HT")
    add(True, 24, b"TP/1.1\r\nHost: www.example.com\r\nAccept: */*\r\n\r\n")
    add(False, 24, b"HTTP/1.1 200 OK\r\n\r\nhello")
    add(True, 17)
    return out
