"""Headline numbers."""

from __future__ import annotations

from meshledger.catalog.base import Inputs, query, rounded
from meshledger.catalog.classes import CLASSIFIED, classified
from meshledger.catalog.sql import using
from meshledger.functions import rules as R
from meshledger.operators.dns import attach_fqdn
from meshledger.plans import coverage as v

_T = "bytes_up + bytes_down"
_SHARE = """SELECT name, b / 1e9 AS gb, CAST(b AS DOUBLE) / t AS share_of_total, CAST(b AS DOUBLE) / i AS share_of_internet FROM (
  SELECT unnest([{names}]) AS name, unnest([{sums}]) AS b, t, i FROM (SELECT *, {t} AS t FROM (SELECT CAST(sum({bytes}) AS BIGINT) AS t0,
    CAST(sum(CASE WHEN NOT local THEN {bytes} END) AS BIGINT) AS i, {aggs} FROM {source})))"""
_PEERS = "(SELECT CAST(sum(bytes_a_to_b + bytes_b_to_a) AS BIGINT) FROM p2p)"


def _share_sql(conditions: dict[str, str], source: str, peers: bool) -> str:
    return _SHARE.format(
        names=", ".join(f"'{n}'" for n in conditions), sums=", ".join(f"s{k}" for k in range(len(conditions))),
        t=f"t0 + {_PEERS}" if peers else "t0", bytes=_T, source=source,
        aggs=", ".join(f"CAST(coalesce(sum(CASE WHEN {x} THEN {_T} END), 0) AS BIGINT) AS s{k}" for k, x in enumerate(conditions.values())),
    )


def _cover_sql(conditions: dict[str, str], source: str) -> str:
    parts = [f"""SELECT '{n}' AS name, count(*) FILTER ({x}) AS flow_count, count(*) FILTER ({x}) * 100 / CAST(count(*) AS DOUBLE) AS flow_pct,
      coalesce(sum({_T}) FILTER ({x}), 0) / 1e9 AS gb, CAST(coalesce(sum({_T}) FILTER ({x}), 0) * 100 AS DOUBLE) / sum({_T}) AS gb_pct
      FROM {source} WHERE NOT local""" for n, x in conditions.items()]
    return " UNION ALL ".join(parts)


def _named(i: Inputs):
    return attach_fqdn(i.flows.drop("fqdn"), i.dns, tie="event_id")


_NAMED = """SELECT any_value(f.local) AS local, any_value(f.bytes_up) AS bytes_up, any_value(f.bytes_down) AS bytes_down,
  coalesce(arg_max(d.domain_name, (d.ts, d.domain_name)), '') AS fqdn, count(DISTINCT d.domain_name) AS n
  FROM flows f LEFT JOIN dns d ON d.user_id = f.user_id AND d.ip_address = f.dest_ip AND d.ts < f.start_ts
  WHERE f.user_id IN (SELECT user_id FROM dns) GROUP BY f.event_id"""
_VIDEO = {"adult": "category = 'view'", "video": "category = 'click'", "all_video": "category IN ('view', 'click')"}
_HEAVY = """SELECT fqdn, CAST(sum(bytes_up) AS BIGINT) AS bytes_up, CAST(sum(bytes_down) AS BIGINT) AS bytes_down FROM classified
  WHERE org = 'Unknown (Not Mapped)' OR category = 'Unknown (Not Mapped)' GROUP BY 1 ORDER BY {0} DESC, fqdn LIMIT 2"""

_HEAVY_ADDRESSES = f"""SELECT dest_ip, sum({_T}) / 1e6 AS mbytes_total FROM classified WHERE category = '{R.NO_DNS}' OR org = '{R.NO_DNS}'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {{0}}"""

QUERIES = {
    "heavy_unmapped_by_summary": (
        query(lambda i: v.heavy_unmapped(classified(i), "bytes_down", 2, True)), using("flows", _HEAVY.format("3"), classified=CLASSIFIED),
    ),
    "heavy_addresses_by_summary": (
        query(lambda i: v.heavy_unknown_addresses(classified(i), 40, True)), using("flows", _HEAVY_ADDRESSES.format(40), classified=CLASSIFIED),
    ),
    "heavy_unmapped_downlink": (
        query(lambda i: v.heavy_unmapped(classified(i), "bytes_down", 2)), using("flows", _HEAVY.format("3"), classified=CLASSIFIED),
    ),
    "heavy_unmapped_uplink": (
        query(lambda i: v.heavy_unmapped(classified(i), "bytes_up", 2)), using("flows", _HEAVY.format("2"), classified=CLASSIFIED),
    ),
    "heavy_unknown_addresses": (
        query(lambda i: v.heavy_unknown_addresses(classified(i), 3)),
        using("flows", _HEAVY_ADDRESSES.format(3), classified=CLASSIFIED),
    ),
    "flow_counts": (
        query(lambda i: v.flow_counts(i.flows, i.p2p)),
        using("flows p2p", f"""SELECT n AS internet_flows, m AS intranet_flows, CAST(n AS DOUBLE) / (n + m) AS internet_flow_share, d / 1e9 AS internet_down_gb,
          u / 1e9 AS internet_up_gb, (d + u) / 1e9 AS internet_gb, l / 1e9 AS intranet_gb, CAST(d + u AS DOUBLE) / (d + u + l) AS internet_byte_share,
          (d + u + l) / 1e9 AS total_gb FROM (SELECT count(*) FILTER (NOT local) AS n, count(*) FILTER (local) + (SELECT count(*) FROM p2p) AS m,
            sum(bytes_down) FILTER (NOT local) AS d, sum(bytes_up) FILTER (NOT local) AS u, sum({_T}) FILTER (local) + {_PEERS} AS l FROM flows)"""),
    ),
    "transaction_counts": (
        query(lambda i: v.transaction_counts(i.tx)),
        using("tx", "SELECT count(*) FILTER (kind = 'purchase') AS purchases, count(*) AS transactions FROM tx"),
    ),
    "dns_coverage": (
        query(lambda i: v.dns_coverage(_named(i))),
        using("flows dns", _cover_sql({"mapped": "fqdn <> ''", "unambiguous": "fqdn <> '' AND n = 1", "user_derived": "fqdn <> ''"}, "named"), named=_NAMED),
    ),
    "category_org_coverage": (
        query(lambda i: v.category_org_coverage(classified(i))),
        using("flows", _cover_sql({
            "category_mapped": "category NOT IN ('Unknown (No DNS)', 'Unknown (Not Mapped)', 'Google (No DNS)')",
            "org_mapped": "org NOT IN ('Unknown (No DNS)', 'Unknown (Not Mapped)')"}, "classified"), classified=CLASSIFIED),
    ),
    "distinct_classes": (
        query(lambda i: v.distinct_classes(classified(i))),
        using("flows", "SELECT count(DISTINCT category) AS categories, count(DISTINCT org) AS orgs FROM classified WHERE NOT local", classified=CLASSIFIED),
    ),
    "down_up_ratio": (
        query(lambda i: v.down_up_ratio(i.flows)),
        using("flows", "SELECT CAST(sum(bytes_down) AS DOUBLE) / sum(bytes_up) AS dl_ul_ratio FROM flows WHERE NOT local"),
    ),
    "big_company_share": (
        query(lambda i: v.big_company_share(classified(i), i.p2p)),
        using("flows p2p", _share_sql({"facebook": "org IN ('Facebook', 'Instagram', 'WhatsApp')", "google": "org = 'Google'",
              "both": "org IN ('Facebook', 'Instagram', 'WhatsApp', 'Google')"}, "classified", True), classified=CLASSIFIED),
    ),
    "video_share": (
        query(lambda i: v.video_share(i.flows, i.p2p, "view", "click")), using("flows p2p", _share_sql(_VIDEO, "flows", True)),
    ),
    "video_share_of_top_spenders": (
        query(lambda i: v.video_share_of_top_spenders(i.flows, i.tx, 10, "view", "click")),
        using("flows purchases", _share_sql(_VIDEO, "topped", False), topped="""SELECT * FROM flows WHERE user_id IN (
          SELECT user_id FROM purchases GROUP BY 1 QUALIFY rank() OVER (ORDER BY sum(amount_idr) DESC) <= 10)"""),
    ),
    "call_share": (
        query(lambda i: v.call_share(i.flows, i.p2p, "signup", "error")),
        using("flows p2p", _share_sql({"p2p": "category = 'signup'", "ice": "category = 'error'", "all_calls": "category IN ('signup', 'error')"}, "flows", True)),
    ),
    "call_users": (
        query(lambda i: v.call_users(i.flows, "signup", "error")),
        using("flows", "SELECT count(DISTINCT user_id) AS unique_users FROM flows WHERE category IN ('signup', 'error')"),
    ),
    "filter_funnel": (
        query(lambda i: v.filter_funnel(i.served, i.served_p2p, i.activity)),
        using("activity users7", """SELECT *, final_users / CAST(users AS DOUBLE) AS final_share,
          (SELECT count(*) FROM served WHERE user_id IN (SELECT user_id FROM users7)) AS typical_flows, (SELECT count(*) FROM served_p2p) AS p2p_flows,
          (SELECT count(*) FROM served WHERE user_id IN (SELECT user_id FROM users7)) + (SELECT count(*) FROM served_p2p) AS total_flows
          FROM (SELECT count(*) AS users, count(*) FILTER (days_since_first_active < 7) AS joined_under_week,
            count(*) FILTER (days_since_first_active >= 7 AND days_active < 1) AS active_under_day,
            count(*) FILTER (days_since_first_active >= 7 AND days_active >= 1) AS final_users FROM activity)"""),
    ),
    "consistently_online_users": (
        query(lambda i: rounded(v.consistently_online(i.activity), 9, "median_ratio")),
        using("users7", """SELECT count(*) FILTER (r >= 0.95) AS consistently_on, count(*) AS users, count(*) FILTER (r >= 0.95) / CAST(count(*) AS DOUBLE) AS share,
          round(median(r), 9) AS median_ratio FROM (SELECT least(days_online, days_active) / nullif(days_active - outage_impact_days, 0) AS r FROM users7)"""),
    ),
}
