"""Schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

_ts = T.TimestampNTZType()
_long = T.LongType()
_int = T.IntegerType()
_str = T.StringType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


FLOWS = _schema(
    start_ts=_ts, end_ts=_ts, user_id=_str, dest_ip=_str, user_port=_int, dest_port=_int,
    bytes_up=_long, bytes_down=_long, protocol=_int,
)
ENRICHED_FLOWS = T.StructType(
    FLOWS.fields
    + _schema(
        fqdn=_str, ambiguous_fqdn_count=_int, fqdn_source=_str, org=_str, category=_str,
        local=T.BooleanType(),
    ).fields
)
PEER_FLOWS = _schema(
    start_ts=_ts, end_ts=_ts, user_a=_str, user_b=_str, a_port=_int, b_port=_int,
    bytes_a_to_b=_long, bytes_b_to_a=_long, protocol=_int,
)
NOUSER_FLOWS = _schema(
    start_ts=_ts, end_ts=_ts, ip_a=_str, ip_b=_str, a_port=_int, b_port=_int,
    bytes_a_to_b=_long, bytes_b_to_a=_long, protocol=_int,
)
DNS = _schema(
    ts=_ts, user_id=_str, dns_server=_str, user_port=_int, server_port=_int, protocol=_int,
    opcode=_int, resultcode=_int, domain_name=_str, ip_address=_str, ttl=_int,
)
TRANSACTIONS = _schema(
    ts=_ts, kind=_str, user_id=_str, dest_user_id=_str, amount_bytes=_long, amount_idr=_long,
)
GAPS = _schema(gap_start=_ts, gap_end=_ts)
