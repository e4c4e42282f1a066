"""Classification, anonymity and call tracing."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import functions as F

from meshledger.catalog.base import ROWS, Inputs, query
from meshledger.catalog.sql import using
from meshledger.functions import rules as R
from meshledger.functions.addresses import NOT_GLOBAL_V4, NOT_GLOBAL_V6, mark_local
from meshledger.operators import classify as c
from meshledger.operators import trace
from meshledger.sources import derived


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _any_sql(x: str, marks) -> str:
    def one(mark) -> str:
        if isinstance(mark, tuple):
            return "(" + " AND ".join(f"contains({x}, {_quoted(m)})" for m in mark) + ")"
        return f"contains({x}, {_quoted(mark)})"

    return "(" + " OR ".join(map(one, marks)) + ")"


def _regex_sql(x: str, pattern: str) -> str:
    """DuckDB has no look-ahead: the forbidden word becomes a second test."""
    ahead = re.match(r"\^\(\?:\(\?!(\w+)\)\.\)\*(.*)", pattern)
    if ahead:
        word, rest = ahead.groups()
        return f"(regexp_matches({x}, {_quoted('^.*' + rest)}) AND NOT contains({x}, {_quoted(word)}))"
    return f"regexp_matches({x}, {_quoted('^(?:' + pattern + ')')})"


def _patterns_sql(x: str, patterns, renamed, default: str) -> str:
    whens = [
        f"WHEN {_regex_sql(x, p)} THEN {_quoted(renamed.get(v, v))}" for p, v in reversed(patterns)
    ]
    return f"CASE {' '.join(whens)} ELSE {default} END"


def domain_sql(x: str) -> tuple[str, str]:
    fallback = f"CASE WHEN {_regex_sql(x, R.GOOGLE_FALLBACK[0])} THEN 'API' ELSE '{R.NOT_MAPPED}' END"
    google = _patterns_sql(x, R.GOOGLE_PATTERNS, R.GOOGLE_RENAMED, fallback)
    facebook = _patterns_sql(x, R.FACEBOOK_PATTERNS, R.FACEBOOK_RENAMED, f"'{R.NOT_MAPPED}'")

    def chain(g: str, f: str, column: int) -> str:
        rest = " ".join(f"WHEN {_any_sql(x, r[2])} THEN {_quoted(r[column])}" for r in R.DOMAIN_RULES)
        return (
            f"CASE WHEN coalesce({x}, '') = '' THEN '{R.NO_DNS}' WHEN {_any_sql(x, R.GOOGLE_MARKS)} THEN {g} "
            f"WHEN {_any_sql(x, R.FACEBOOK_MARKS)} THEN {f} {rest} ELSE '{R.NOT_MAPPED}' END"
        )

    return chain("'Google'", "'Facebook'", 0), chain(google, facebook, 1)


def address_sql(x: str) -> tuple[str, str]:
    def test(how: str, texts) -> str:
        call = {"contains": "contains", "startswith": "starts_with"}[how]
        return "(" + " OR ".join(f"{call}({x}, '{t}')" for t in texts) + ")"

    def chain(column: int) -> str:
        whens = " ".join(f"WHEN {test(r[2], r[3])} THEN '{r[column]}'" for r in R.ADDRESS_RULES)
        return f"CASE {whens} ELSE '{R.NO_DNS}' END"

    return chain(0), chain(1)


_ORG, _CATEGORY = domain_sql("fqdn")
_IP_ORG, _IP_CATEGORY = address_sql("dest_ip")
_SETUP = "(protocol = 17 AND dest_port = 3478)"
_FB_IP = "(contains(dest_ip, '157.240.25.') OR contains(dest_ip, '157.240.24.') OR contains(dest_ip, '157.240.2.'))"
_LOCAL_IP = "dest_ip IN ('10.10.20.1', '192.168.151.1', '203.0.113.5')"

# Flows classified by name, call-setup port and Facebook address, as classify_flows does.
CLASSIFIED = f"""SELECT event_id, start_ts, end_ts, user_id, dest_ip, user_port, dest_port, protocol, bytes_up, bytes_down, fqdn,
  CASE WHEN o = '{R.NO_DNS}' AND {_FB_IP} THEN 'Facebook' ELSE o END AS org,
  CASE WHEN {_SETUP} THEN '{R.ICE}' WHEN g = '{R.NO_DNS}' AND {_FB_IP} THEN '{R.NOT_MAPPED}' ELSE g END AS category,
  {_LOCAL_IP} AS local
  FROM flows JOIN (SELECT f AS ff, o, g FROM (SELECT fqdn AS f, {_ORG} AS o, {_CATEGORY} AS g FROM (SELECT DISTINCT fqdn FROM flows))) ON fqdn = ff"""

_OCTETS = """concat(([0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255])[event_id % 13 + 1], '.',
  ([0, 2, 16, 18, 31, 32, 51, 64, 88, 127, 128, 168, 254, 255])[event_id // 13 % 14 + 1], '.',
  ([0, 2, 100, 113, 255])[event_id // 182 % 5 + 1], '.', event_id * 7 % 256)"""
_SPARK_OCTETS = """concat_ws('.', element_at(array(0, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255), CAST(event_id % 13 + 1 AS INT)),
  element_at(array(0, 2, 16, 18, 31, 32, 51, 64, 88, 127, 128, 168, 254, 255), CAST(event_id div 13 % 14 + 1 AS INT)),
  element_at(array(0, 2, 100, 113, 255), CAST(event_id div 182 % 5 + 1 AS INT)), event_id * 7 % 256)"""


def _number(dotted: str) -> str:
    parts = [f"CAST(split_part({dotted}, '.', {i}) AS BIGINT)" for i in range(1, 5)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


def _blocks(n: str) -> str:
    nets = map(ipaddress.ip_network, NOT_GLOBAL_V4)
    return " OR ".join(f"{n} BETWEEN {int(b.network_address)} AND {int(b.broadcast_address)}" for b in nets)


def _protocols(i: Inputs):
    ports = i.flows.withColumn("dest_port", F.expr(
        "element_at(array(22, 25, 53, 80, 123, 143, 220, 443, 993, 3478, 5349, 9), CAST(event_id % 12 + 1 AS INT))"
    )).withColumn("protocol", F.expr("element_at(array(6, 17, 1), CAST(event_id % 3 + 1 AS INT))"))
    named = ports.withColumn("name", c.protocol_name("protocol", "dest_port"))
    return named.groupBy("protocol", "dest_port", "name").agg(F.count(F.lit(1)).alias("flows"))


def classified(i: Inputs):
    return c.classify_flows(i.flows)


def _few_peers(i: Inputs):
    return few_peers(classified(i))


def few_peers(flows):
    """Few users and addresses, so that 5-tuples repeat and calls chain."""
    return flows.withColumns({
        "user_id": F.col("user_id") % 10, "user_port": F.lit(40000),
        "dest_ip": F.when(F.col("event_id") % 2 == 0, "23.248.162.7").otherwise("74.125.24.1"),
    })


_FEW = """SELECT event_id, start_ts, end_ts, user_id % 10 AS user_id, CASE WHEN event_id % 2 = 0 THEN '23.248.162.7' ELSE '74.125.24.1' END AS dest_ip,
  40000 AS user_port, dest_port, protocol, fqdn, org, category FROM classified"""
_TRACE = f"""WITH RECURSIVE {{views}}, classified AS ({CLASSIFIED}), few AS ({_FEW}),
  kinds AS (SELECT *, ((category IN ('{R.NO_DNS}', '{R.NOT_MAPPED}') AND contains(org, 'Unknown')) OR contains(fqdn, '{R.HINET}')) AS peer,
    (contains(fqdn, 'turnservice') OR contains(fqdn, 'facebook') OR org = 'Facebook' OR category IN ('{R.NOT_MAPPED}', 'API')) AS service FROM few),
  open AS (SELECT * FROM kinds WHERE (peer OR service) AND NOT {_SETUP}),
  seeds AS (SELECT DISTINCT o.event_id FROM open o JOIN few s ON s.user_id = o.user_id AND s.user_port = o.user_port AND s.protocol = 17 AND s.dest_port = 3478
    AND s.start_ts <= o.start_ts AND o.start_ts < s.start_ts + INTERVAL {{setup}} SECOND),
  hit AS (SELECT * FROM open WHERE event_id IN (SELECT event_id FROM seeds)
    UNION SELECT k.* FROM open k JOIN hit j ON k.user_id = j.user_id AND k.user_port = j.user_port AND k.dest_port = j.dest_port AND k.protocol = j.protocol
      AND k.dest_ip = j.dest_ip AND k.start_ts > j.start_ts AND k.start_ts < j.end_ts + INTERVAL {{chain}} SECOND)
  SELECT event_id, CASE WHEN h AND peer THEN '{R.ICE_PEER_ORG}' ELSE org END AS org,
    CASE WHEN h AND peer THEN '{R.PEER_TO_PEER}' WHEN h AND service THEN '{R.ICE}' ELSE category END AS category
  FROM (SELECT *, event_id IN (SELECT event_id FROM hit) AS h FROM kinds)"""


def trace_sql(setup: int, chain: int) -> str:
    views = using("flows", "").removeprefix("WITH ").strip()
    return _TRACE.format(views=views, setup=setup, chain=chain)


def _anonymized(k: int, label: str = R.ANONYMIZED_ORG, zero: str | None = None):
    def build(i: Inputs):
        out = c.k_anonymize(i.flows, "org", "user_id", k, label, zero)
        return out.select("event_id", "user_id", "org")

    return query(build)


_RELABEL = """SELECT event_id, user_id, CASE WHEN org IN (SELECT org FROM flows WHERE {0} GROUP BY org HAVING count(DISTINCT user_id) < {1})
  THEN '{2}' ELSE org END AS org FROM flows"""

# Addresses of every form, by event: v4; v6 in full, shortened, with a dotted tail, in capitals; no address.
_GROUPS = ("fc12", "fe80", "2001", "2606", "0100", "2a00", "febf", "fec0", "0000", "01ff")
_HEX4 = "lpad(lower(hex(event_id * {} % 65536)), 4, '0')"
_MIXED_V4 = "concat({})".format(", '.', ".join(f"CAST(event_id * {m} % 256 AS STRING)" for m in (7, 13, 3, 11)))
_MIXED = f"""CASE event_id % 6 WHEN 0 THEN {_MIXED_V4}
  WHEN 1 THEN concat({{head}}, ':', {_HEX4.format(7919)}, ':0000:', {_HEX4.format(31)}, ':0:0:1:', {_HEX4.format(17)})
  WHEN 2 THEN concat({{head}}, '::', lower(hex(event_id % 65536))) WHEN 3 THEN concat('::ffff:', {_MIXED_V4})
  WHEN 4 THEN upper(concat({{head}}, ':', lower(hex(event_id % 32)), '::')) ELSE 'host.example.org' END"""
_SPARK_HEAD = f"element_at(array({', '.join(map(repr, _GROUPS))}), CAST(event_id % {len(_GROUPS)} + 1 AS INT))"
_DUCK_HEAD = f"([{', '.join(map(repr, _GROUPS))}])[event_id % {len(_GROUPS)} + 1]"
_V4_PARTS = [f"event_id * {m} % 256" for m in (7, 13, 3, 11)]
_V4_NUMBER = "(" + " + ".join(f"({p}) * {256 ** (3 - k)}" for k, p in enumerate(_V4_PARTS)) + ")"
_V4_HEX = " || ".join(f"lpad(lower(hex({p})), 2, '0')" for p in _V4_PARTS)


def _mixed(i: Inputs):
    return i.table("events").selectExpr("event_id", _MIXED.format(head=_SPARK_HEAD) + " AS ip")


def _in_v6(x: str) -> str:
    nets = map(ipaddress.ip_network, NOT_GLOBAL_V6)
    return "(" + " OR ".join(f"{x} BETWEEN '{int(n.network_address):032x}' AND '{int(n.broadcast_address):032x}'" for n in nets) + ")"


# The oracle knows the digits from how the address was made, and tests every block.
_MIXED_SQL = f"""SELECT event_id, ip, coalesce(CASE WHEN event_id % 6 = 0 THEN {_blocks(_V4_NUMBER)} ELSE {_in_v6('digits')} END, false) AS local
FROM (SELECT event_id, {_MIXED.format(head=_DUCK_HEAD).replace('STRING', 'VARCHAR')} AS ip, CASE event_id % 6
    WHEN 1 THEN {_DUCK_HEAD} || {_HEX4.format(7919)} || '0000' || {_HEX4.format(31)} || '000000000001' || {_HEX4.format(17)}
    WHEN 2 THEN {_DUCK_HEAD} || repeat('0', 24) || lpad(lower(hex(event_id % 65536)), 4, '0')
    WHEN 3 THEN repeat('0', 20) || 'ffff' || {_V4_HEX}
    WHEN 4 THEN {_DUCK_HEAD} || lpad(lower(hex(event_id % 32)), 4, '0') || repeat('0', 24) END AS digits FROM events)"""

QUERIES = {
    "domain_classes": (
        query(lambda i: c.classify_domain(derived.named_domains(i.spark, i.sf_dir))),
        f"""SELECT event_id, user_id, fqdn, {_ORG} AS org, {_CATEGORY} AS category FROM (
          SELECT event_id, user_id, ([{', '.join(_quoted(d) for d in derived.sample_domains())}])[event_id % {len(derived.sample_domains())} + 1] AS fqdn FROM events)""",
    ),
    "page_host_classes": (
        query(lambda i: c.classify_domain(i.table("pages").select("page_id", F.regexp_extract("url", r"https?://([^/]+)", 1).alias("fqdn")))),
        f"""SELECT page_id, fqdn, {_ORG} AS org, {_CATEGORY} AS category FROM (SELECT page_id, regexp_extract(url, 'https?://([^/]+)', 1) AS fqdn FROM pages)""",
    ),
    "address_classes": (
        query(lambda i: c.classify_ip(i.flows.select("event_id", "dest_ip"))),
        using("flows", f"SELECT event_id, dest_ip, {_IP_ORG} AS org, {_IP_CATEGORY} AS category FROM flows"),
    ),
    "protocol_names": (
        query(_protocols),
        using("flows", """SELECT protocol, dest_port, CASE
            WHEN protocol = 6 THEN coalesce(map {22: 'SSH', 25: 'SMTP', 53: 'DNS', 80: 'HTTP', 143: 'IMAP', 220: 'IMAP', 443: 'HTTPS', 993: 'IMAP', 5349: 'STUN/TURN TLS'}[dest_port], 'Other TCP')
            WHEN protocol = 17 THEN coalesce(map {53: 'DNS', 80: 'HTTP/3 (QUIC)', 123: 'NTP', 143: 'IMAP', 443: 'HTTP/3 (QUIC)', 3478: 'STUN/TURN'}[dest_port], 'Other UDP')
            ELSE 'Other' END AS name, count(*) AS flows FROM (
          SELECT CAST(([22, 25, 53, 80, 123, 143, 220, 443, 993, 3478, 5349, 9])[event_id % 12 + 1] AS INTEGER) AS dest_port,
            CAST(([6, 17, 1])[event_id % 3 + 1] AS INTEGER) AS protocol FROM events) GROUP BY 1, 2, 3"""),
    ),
    "local_addresses": (
        query(lambda i: mark_local(i.table("events").selectExpr("event_id", f"{_SPARK_OCTETS} AS ip"), "ip")),
        f"SELECT event_id, ip, {_blocks(_number('ip'))} AS local FROM (SELECT event_id, {_OCTETS} AS ip FROM events)",
    ),
    "local_addresses_mixed": (
        query(lambda i: mark_local(_mixed(i), "ip").select("event_id", "ip", "local")), _MIXED_SQL,
    ),
    "classified_flows": (
        query(lambda i: classified(i).select("event_id", "org", "category", "local")),
        using("flows", "SELECT event_id, org, category, local FROM classified", classified=CLASSIFIED),
    ),
    "classified_flows_by_address": (
        query(lambda i: c.classify_remaining_by_ip(classified(i)).select("event_id", "org", "category")),
        using("flows", f"""SELECT event_id, CASE WHEN org = '{R.NO_DNS}' THEN {_IP_ORG} ELSE org END AS org,
          CASE WHEN category = '{R.NO_DNS}' THEN {_IP_CATEGORY} ELSE category END AS category FROM classified""", classified=CLASSIFIED),
    ),
    "anonymized_orgs": (_anonymized(5), using("flows", _RELABEL.format("true", 5, R.ANONYMIZED_ORG))),
    "anonymized_orgs_with_bytes": (
        _anonymized(149, R.AGGREGATED_ORG, "bytes_down"), using("flows", _RELABEL.format("bytes_down <> 0", 149, R.AGGREGATED_ORG)),
    ),
    "call_trace": (
        query(lambda i: trace.trace_ice(_few_peers(i), 21600, 43200, ROWS).select("event_id", "org", "category")),
        trace_sql(21600, 43200),
    ),
    "call_trace_one_minute": (
        query(lambda i: trace.trace_ice(_few_peers(i)).select("event_id", "org", "category")), trace_sql(60, 5),
    ),
}
