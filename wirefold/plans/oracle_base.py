"""Shared DuckDB SQL for the oracle side: expected packets straight from ``events``.

The oracle never parses bytes: every header field, flag and length below is
written from the ``events`` columns and the synthetic frame rules
(``wirefold.sources.synthetic``), so a decoder or parser bug shows up as a
mismatch. Only the byte-level checks (md5 of rewritten bytes, vector
digests) build hex text, with the same frame rules.
"""

from __future__ import annotations

from wirefold.sources.synthetic import PREFIXES, RECORDS_PER_CAPTURE, TCP_FLAGS_BY_EVENT, frame_hex_sql

_FLAGS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TCP_FLAGS_BY_EVENT.items())
_FLAGS_INT = " ".join(f"WHEN '{k}' THEN {int(v, 16)}" for k, v in TCP_FLAGS_BY_EVENT.items())
_PREFIX_LIST = "[" + ", ".join(f"'{p}'" for p in PREFIXES) + "]"

# ev: one row per event with every expected packet field.
EV_CTE = f"""
ev0 AS (
  SELECT event_id, user_id, event_type, ts, props,
         event_id % 3 = 0 AS is_udp,
         CASE WHEN event_id % 7 = 0 THEN 53 ELSE 443 END AS dport,
         1024 + event_id % 60000 AS sport,
         CASE WHEN event_type = 'error' THEN '' ELSE hex(props) END AS payload_hex,
         CASE event_type {_FLAGS} ELSE '00' END AS flags_hex,
         CASE event_type {_FLAGS_INT} ELSE 0 END AS flags_int,
         CASE WHEN event_type = 'error' THEN 0 ELSE strlen(props) END AS plen,
         {_PREFIX_LIST}[user_id % {len(PREFIXES)} + 1] AS prefix,
         event_id // {RECORDS_PER_CAPTURE} AS chunk,
         epoch_us(ts) AS ts_us
  FROM events),
ev1 AS (
  SELECT *, CASE WHEN is_udp THEN 8 ELSE 20 END AS l4len,
         '/captures/' || prefix || '.' || user_id || '.' || chunk || '.pcap' AS path,
         lower(prefix) AS lprefix,
         CAST(row_number() OVER (PARTITION BY user_id, chunk ORDER BY event_id) - 1 AS BIGINT) AS packet_no
  FROM ev0),
ev AS (
  SELECT *, 20 + l4len + plen AS ip_total,
         greatest(60, 34 + l4len + plen) AS frame_len,
         greatest(0, 60 - (34 + l4len + plen)) AS pad_len,
         {frame_hex_sql('//')} AS frame_hex,
         (NOT is_udp AND (flags_int & 19) <> 0 AND plen = 0) AS is_control,
         (plen > 0 AND ((is_udp AND (sport IN (53, 5353) OR dport IN (53, 5353)))
                        OR (NOT is_udp AND (sport = 53 OR dport = 53)))) AS is_dns
  FROM ev1)
"""

# kept: packets that yield a sample, with the rewritten bytes (UDP zeros after the header).
KEPT_CTE = EV_CTE + """,
kept AS (
  SELECT *,
         '4500' || lpad(hex(ip_total), 4, '0') || lpad(hex(event_id % 65536), 4, '0') || '4000' || '40'
         || (CASE WHEN is_udp THEN '11' ELSE '06' END) || '0000' || '0000000000000000'
         || lpad(hex(sport), 4, '0') || lpad(hex(dport), 4, '0')
         || (CASE WHEN is_udp THEN lpad(hex(8 + plen), 4, '0') || '0000' || repeat('00', 12)
             ELSE '00000001' || '00000002' || '50' || flags_hex || 'FFFF' || '0000' || '0000' END)
         || payload_hex || repeat('00', pad_len) AS fhex
  FROM ev WHERE NOT is_control AND NOT is_dns)
"""


def byte_digest_sql(h: str) -> str:
    """vec_len, n_nonzero, byte_sum, weighted_sum of a hex string (<= 1500 bytes)."""
    bytes_ = f"list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::INTEGER)"
    return (
        f"1500 AS vec_len, "
        f"CAST(len(list_filter({bytes_}, lambda b: b <> 0)) AS INTEGER) AS n_nonzero, "
        f"CAST(coalesce(list_sum({bytes_}), 0) AS BIGINT) AS byte_sum, "
        f"CAST(coalesce(list_sum(list_transform(range(0, length({h}) // 2), "
        f"lambda i: (i + 1) * ('0x' || substr({h}, 2 * i + 1, 2))::INTEGER)), 0) AS BIGINT) AS weighted_sum"
    )


def with_kept(select: str) -> str:
    return "WITH " + KEPT_CTE + select


def with_ev(select: str) -> str:
    return "WITH " + EV_CTE + select
