"""Vectorised header parsing over a batch of packets (numpy, inside Spark tasks).

Header offsets depend on each other (link header -> tags -> IP header length ->
extension headers -> tunnels -> L4 header), which as staged Spark projections
makes any later filter on the fields expand exponentially when Catalyst pushes
it down.  Here a whole Arrow batch is walked layer by layer: every packet is at
some layer and offset, a step moves the packets of one layer on to the next,
and a packet that has reached its last layer is touched no more.  Every layer
has a size, so the walk ends with the bytes; any number of layers is followed.  The result is plain integer columns that filters and
projections use freely.

Layers: Ethernet, VLAN tags, PPPoE, PPP, MPLS, GRE, IPv4 and IPv6 with
extension headers, IP in IP, TCP and UDP.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Link-layer types (public registry), ethertypes, protocol numbers.
LINKTYPE_NULL = 0
LINKTYPE_ETHERNET = 1
LINKTYPE_RAW = 101
LINKTYPE_LINUX_SLL = 113
LINKTYPE_IPV4 = 228
LINKTYPE_IPV6 = 229
LINKTYPE_LINUX_SLL2 = 276
ETH_IPV4 = 0x0800
ETH_IPV6 = 0x86DD
ETH_VLAN = (0x8100, 0x88A8, 0x9100)
ETH_MPLS = (0x8847, 0x8848)
ETH_PPPOE = 0x8864
ETH_BRIDGED = 0x6558
PPP_IPV4 = 0x0021
PPP_IPV6 = 0x0057
PROTO_IPV4 = 4
PROTO_TCP = 6
PROTO_UDP = 17
PROTO_IPV6 = 41
PROTO_GRE = 47
IPV6_EXT_HEADERS = (0, 43, 60)  # hop-by-hop, routing, destination options
IPV6_FRAGMENT = 44
PROTO_AUTHENTICATION = 51

HDR_FIELDS = [
    "l2_off", "ethertype", "ip_version", "ip_hlen", "ip_off", "ip_flags", "proto", "total_len",
    "l4_off", "sport", "dport", "tcp_flags", "l4_hlen", "payload_off", "payload_len", "pad_len",
    "ip4_off", "ip6_off", "ip_layers",
]
NULL = -1

# Layers of the walk.
END, LINK_TYPE, IP, EXTENSION, ETHERNET, MPLS, PPPOE, GRE, IPV4, IPV6, PROTOCOL = range(11)
BY_ETHERTYPE = {ETH_IPV4: IPV4, ETH_IPV6: IPV6, ETH_PPPOE: PPPOE, ETH_BRIDGED: ETHERNET, **dict.fromkeys(ETH_MPLS, MPLS)}
BY_PPP = {PPP_IPV4: IPV4, PPP_IPV6: IPV6}
BY_PROTOCOL = {PROTO_IPV4: IPV4, PROTO_IPV6: IPV6, PROTO_GRE: GRE}


def _next(table: dict[int, int], keys: np.ndarray) -> np.ndarray:
    out = np.full(len(keys), END)
    for k, layer in table.items():
        out[keys == k] = layer
    return out


class _Walk:
    """Layer and offset of every packet of a batch, and the fields found so far."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray, linktypes: np.ndarray):
        n = len(lens)
        self.flat, self.starts, self.lens, self.linktypes = flat, starts, lens, linktypes
        self.f = {name: np.full(n, NULL, np.int64) for name in HDR_FIELDS}
        self.layer = np.zeros(n, np.int64)
        self.at = np.zeros(n, np.int64)
        self.kind = np.zeros(n, np.int64)  # ethertype or protocol of what lies at ``at``
        self.end = lens.copy()  # of what the IP layers so far hold
        self.first_ip = np.full(n, NULL, np.int64)

    def byte(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        ok = (off >= 0) & (off < self.lens[rows])
        return np.where(ok, self.flat[np.where(ok, self.starts[rows] + off, 0)].astype(np.int64), NULL)

    def word(self, rows: np.ndarray, off: np.ndarray) -> np.ndarray:
        high, low = self.byte(rows, off), self.byte(rows, off + 1)
        return np.where((high >= 0) & (low >= 0), high * 256 + low, NULL)

    def go(self, rows: np.ndarray, layer, at, kind=0) -> None:
        self.layer[rows], self.at[rows], self.kind[rows] = layer, at, kind

    # Each step takes the packets that are at its layer.

    def link(self) -> None:
        lt, rows = self.linktypes, np.arange(len(self.lens))
        size = np.select([lt == LINKTYPE_ETHERNET, np.isin(lt, (LINKTYPE_RAW, LINKTYPE_IPV4, LINKTYPE_IPV6)), lt == LINKTYPE_LINUX_SLL,
                          lt == LINKTYPE_LINUX_SLL2, lt == LINKTYPE_NULL], [14, 0, 16, 20, 4], NULL)
        type_at = np.select([lt == LINKTYPE_ETHERNET, lt == LINKTYPE_LINUX_SLL, lt == LINKTYPE_LINUX_SLL2], [12, 14, 0], NULL)
        self.f["l2_off"] = size.copy()
        typed = rows[type_at >= 0]
        self.go(typed, LINK_TYPE, size[typed], self.word(typed, type_at[typed]))
        plain = rows[(size >= 0) & (type_at < 0)]
        version = self.byte(plain, size[plain]) // 16
        self.f["ethertype"][plain] = np.select([version == 4, version == 6], [ETH_IPV4, ETH_IPV6], NULL)
        self.go(plain, IP, size[plain])

    def link_type(self, rows: np.ndarray) -> None:
        kind, at = self.kind[rows], self.at[rows]
        tag = np.isin(kind, ETH_VLAN) & (self.word(rows, at + 2) >= 0)
        self.go(rows[tag], LINK_TYPE, at[tag] + 4, self.word(rows[tag], at[tag] + 2))
        rest, at, kind = rows[~tag], at[~tag], kind[~tag]
        outer = self.f["ethertype"][rest] < 0  # not within a tunnel
        self.f["l2_off"][rest[outer]] = at[outer]
        self.f["ethertype"][rest[outer]] = kind[outer]
        self.go(rest, _next(BY_ETHERTYPE, kind), at)

    def ethernet(self, rows: np.ndarray) -> None:
        self.go(rows, LINK_TYPE, self.at[rows] + 14, self.word(rows, self.at[rows] + 12))

    def pppoe(self, rows: np.ndarray) -> None:
        self.go(rows, _next(BY_PPP, self.word(rows, self.at[rows] + 6)), self.at[rows] + 8)

    def mpls(self, rows: np.ndarray) -> None:
        last = self.byte(rows, self.at[rows] + 2) % 2 == 1  # bottom of the stack; also where the bytes end
        self.go(rows, np.where(last, IP, MPLS), self.at[rows] + 4)

    def gre(self, rows: np.ndarray) -> None:
        flags, at = self.byte(rows, self.at[rows]), self.at[rows]
        version = self.byte(rows, at + 1) % 8
        size = 4 + 4 * (flags // 128 % 2) + 4 * (flags // 32 % 2) + 4 * (flags // 16 % 2)
        plain = (flags >= 0) & (version == 0)
        self.go(rows, np.where(plain, LINK_TYPE, END), at + size, self.word(rows, at + 2))

    def ip(self, rows: np.ndarray) -> None:
        version = self.byte(rows, self.at[rows]) // 16
        self.go(rows, np.select([version == 4, version == 6], [IPV4, IPV6], END), self.at[rows])

    def _ip_fields(self, rows: np.ndarray, version: int, length: np.ndarray, flags) -> None:
        at = self.at[rows]
        first = self.f["ip_layers"][rows] < 0
        outer = rows[first]
        self.f["ip_version"][outer], self.f["ip_off"][outer] = version, at[first]
        self.f["total_len"][outer], self.f["ip_flags"][outer] = length[first], np.broadcast_to(flags, len(rows))[first]
        name = "ip4_off" if version == 4 else "ip6_off"
        new = self.f[name][rows] < 0
        self.f[name][rows[new]] = at[new]
        self.f["ip_layers"][rows] = np.maximum(self.f["ip_layers"][rows], 0) + 1

    def _ends(self, rows: np.ndarray, end: np.ndarray, open_end: np.ndarray) -> None:
        """Bytes after the end of an IP layer are padding; a length that can't be right bounds nothing."""
        outer = self.f["ip_layers"][rows] == 1
        bound = np.where(open_end, self.end[rows], end)
        self.f["pad_len"][rows[outer]] = np.maximum(0, self.lens[rows] - bound)[outer]
        self.end[rows] = np.minimum(self.end[rows], bound)

    def ipv4(self, rows: np.ndarray) -> None:
        at = self.at[rows]
        whole = (self.byte(rows, at) // 16 == 4) & (self.lens[rows] >= at + 20)
        self.layer[rows[~whole]] = END
        rows, at = rows[whole], at[whole]
        size, total = self.byte(rows, at) % 16 * 4, self.word(rows, at + 2)
        self._ip_fields(rows, 4, total, self.byte(rows, at + 6) // 32)
        self._ends(rows, at + total, total < size)
        later = self.word(rows, at + 6) % 8192 != 0  # a fragment other than the first has no L4 header
        proto = self.byte(rows, at + 9)
        self.f["proto"][rows] = proto
        outer = self.f["ip_layers"][rows] == 1
        self.f["ip_hlen"][rows[outer]] = size[outer]
        self.go(rows, np.where(later | (size < 20), END, PROTOCOL), at + size, proto)

    def ipv6(self, rows: np.ndarray) -> None:
        at = self.at[rows]
        whole = (self.byte(rows, at) // 16 == 6) & (self.lens[rows] >= at + 40)
        self.layer[rows[~whole]] = END
        rows, at = rows[whole], at[whole]
        total = 40 + self.word(rows, at + 4)
        self._ip_fields(rows, 6, total, NULL)
        self._ends(rows, at + total, total == 40)
        proto = self.byte(rows, at + 6)
        self.f["proto"][rows] = proto
        outer = self.f["ip_layers"][rows] == 1
        self.f["ip_hlen"][rows[outer]] = 40
        self.go(rows, EXTENSION, at + 40, proto)

    def extension(self, rows: np.ndarray) -> None:
        at, kind = self.at[rows], self.kind[rows]
        fragment, extra = kind == IPV6_FRAGMENT, np.isin(kind, IPV6_EXT_HEADERS)
        over = ~(fragment | extra) | (self.byte(rows, at + 1) < 0)
        self.go(rows[over], PROTOCOL, at[over], kind[over])
        rows, at, fragment = rows[~over], at[~over], fragment[~over]
        size = np.where(fragment, 8, (self.byte(rows, at + 1) + 1) * 8)
        later = fragment & (self.word(rows, at + 2) > 7)
        proto = self.byte(rows, at)
        self.f["proto"][rows] = proto
        outer = self.f["ip_layers"][rows] == 1
        self.f["ip_hlen"][rows[outer]] += size[outer]
        self.go(rows, np.where(later, END, EXTENSION), at + size, proto)

    def protocol(self, rows: np.ndarray) -> None:
        at, kind = self.at[rows], self.kind[rows]
        self.f["l4_off"][rows] = at
        sealed = (kind == PROTO_AUTHENTICATION) & (self.byte(rows, at + 1) >= 0)
        inner = _next(BY_PROTOCOL, kind)
        tcp = (kind == PROTO_TCP) & (self.lens[rows] >= at + 20)
        udp = (kind == PROTO_UDP) & (self.lens[rows] >= at + 8)
        l4, t = rows[tcp | udp], rows[tcp]
        size = np.where(tcp, self.byte(rows, at + 12) // 16 * 4, 8)[tcp | udp]
        self.f["sport"][l4], self.f["dport"][l4] = self.word(l4, self.at[l4]), self.word(l4, self.at[l4] + 2)
        self.f["tcp_flags"][t] = self.byte(t, self.at[t] + 13)
        self.f["l4_hlen"][l4], self.f["payload_off"][l4] = size, self.at[l4] + size
        self.f["payload_len"][l4] = np.maximum(0, self.end[l4] - self.at[l4] - size)
        step = np.where(sealed, (self.byte(rows, at + 1) + 2) * 4, 0)
        proto = np.where(sealed, self.byte(rows, at), kind)
        self.f["proto"][rows] = proto
        self.go(rows, np.where(sealed, PROTOCOL, inner), at + step, proto)

    STEPS = {LINK_TYPE: link_type, IP: ip, EXTENSION: extension, ETHERNET: ethernet, MPLS: mpls, PPPOE: pppoe, GRE: gre,
             IPV4: ipv4, IPV6: ipv6, PROTOCOL: protocol}

    def run(self) -> dict[str, np.ndarray]:
        self.link()
        open_rows = np.flatnonzero(self.layer != END)
        while len(open_rows):
            layer = self.layer[open_rows]
            for kind, step in self.STEPS.items():
                if len(rows := open_rows[layer == kind]):
                    step(self, rows)
            open_rows = open_rows[self.layer[open_rows] != END]
        return self.f


def header_arrays(packets: pa.Array, linktypes: np.ndarray) -> list[pa.Array]:
    """``HDR_FIELDS`` of a binary array of packets as int32 arrays, null where a field does not exist; a null packet is empty."""
    if isinstance(packets, pa.ChunkedArray):
        packets = packets.combine_chunks()
    packets = packets.cast(pa.large_binary())
    if packets.null_count:
        packets = packets.fill_null(b"")
    n = len(packets)
    offsets = np.frombuffer(packets.buffers()[1], np.int64)[packets.offset:packets.offset + n + 1] if n else np.zeros(1, np.int64)
    data = packets.buffers()[2] if n else None
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    fields = _Walk(flat, offsets[:-1], np.diff(offsets), np.asarray(linktypes, np.int64)).run()
    return [pa.array(v.astype(np.int32), mask=v < 0) for v in fields.values()]
