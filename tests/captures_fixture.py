"""Hand-written capture bytes for decoder and header tests."""

import struct

ETH = bytes.fromhex("020000000001" "020000000002")


def ipv4(proto: int, payload_l4: bytes, options: bytes = b"", flags: int = 0x4000, total: int | None = None) -> bytes:
    ihl = 5 + len(options) // 4
    tot = total if total is not None else 4 * ihl + len(payload_l4)
    return (bytes([0x40 | ihl, 0]) + struct.pack(">HHH", tot, 1, flags) + bytes([64, proto]) + b"\x00\x00"
            + bytes([10, 0, 0, 5]) + bytes([10, 0, 0, 1]) + options + payload_l4)


def tcp(sport: int, dport: int, flags: int, payload: bytes = b"") -> bytes:
    return struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 0x50, flags, 0xFFFF, 0, 0) + payload


def udp(sport: int, dport: int, payload: bytes = b"") -> bytes:
    return struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload


def eth(ethertype: int, body: bytes, vlan: int | None = None) -> bytes:
    tag = struct.pack(">HH", 0x8100, vlan) if vlan is not None else b""
    return ETH + tag + struct.pack(">H", ethertype) + body


def capture(frames, magic: str = "A1B2C3D4", linktype: int = 1, wirelen_extra: int = 0) -> bytes:
    big = magic in ("A1B2C3D4", "A1B23C4D")
    e = ">" if big else "<"
    out = bytes.fromhex(magic) + struct.pack(e + "HHIIII", 2, 4, 0, 0, 65535, linktype)
    for i, fr in enumerate(frames):
        out += struct.pack(e + "IIII", 1_700_000_000 + i, 123 + i, len(fr), len(fr) + wirelen_extra) + fr
    return out


def pcapng(frames, linktype: int = 1) -> bytes:
    def block(btype, body):
        pad = (-len(body)) % 4
        n = 12 + len(body) + pad
        return struct.pack("<II", btype, n) + body + b"\0" * pad + struct.pack("<I", n)

    shb = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    idb = block(1, struct.pack("<HHI", linktype, 0, 65535))
    out = shb + idb
    for i, fr in enumerate(frames):
        t = (1_700_000_000 + i) * 1_000_000 + 5
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(fr), len(fr)) + fr)
    return out
