"""Organisation, category and protocol of a flow from its name, address and ports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from meshledger.functions import rules as R
from meshledger.functions.addresses import mark_local

# The rule tables become flat CASE expressions in SQL text: one parse instead of thousands of
# calls into the JVM, and one flat branch list in the generated code.


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _case(branches: list[tuple[str, str]], default: str) -> str:
    """First branch that holds; tests and results are SQL text."""
    whens = " ".join(f"WHEN {test} THEN {result}" for test, result in branches)
    return f"CASE {whens} ELSE {default} END"


def _any_of(name: str, marks) -> str:
    def one(mark) -> str:
        if isinstance(mark, tuple):
            return "(" + " AND ".join(f"contains({name}, {_text(m)})" for m in mark) + ")"
        return f"contains({name}, {_text(mark)})"

    return "(" + " OR ".join(one(m) for m in marks) + ")"


def _by_pattern(name: str, patterns, renamed: dict, default: str) -> str:
    """The last pattern that matches decides, so they are tried from the end."""
    tried = [
        (f"{name} RLIKE r'{pattern}'", _text(renamed.get(category, category)))
        for pattern, category in reversed(patterns)
    ]
    return _case(tried, default)


def _google(name: str) -> str:
    pattern, category = R.GOOGLE_FALLBACK
    fallback = _case([(f"{name} RLIKE r'{pattern}'", _text(category))], _text(R.NOT_MAPPED))
    return _by_pattern(name, R.GOOGLE_PATTERNS, R.GOOGLE_RENAMED, fallback)


def _facebook(name: str) -> str:
    return _by_pattern(name, R.FACEBOOK_PATTERNS, R.FACEBOOK_RENAMED, _text(R.NOT_MAPPED))


def google_category(fqdn: str) -> Column:
    return F.expr(_google(fqdn))


def facebook_category(fqdn: str) -> Column:
    return F.expr(_facebook(fqdn))


def domain_class(fqdn: str) -> tuple[Column, Column]:
    """(organisation, category) of the domain in column ``fqdn``."""

    def choose(google: str, facebook: str, column: int) -> Column:
        branches = [
            (f"coalesce({fqdn}, '') = ''", _text(R.NO_DNS)),
            (_any_of(fqdn, R.GOOGLE_MARKS), google),
            (_any_of(fqdn, R.FACEBOOK_MARKS), facebook),
            *[(_any_of(fqdn, rule[2]), _text(rule[column])) for rule in R.DOMAIN_RULES],
        ]
        return F.expr(_case(branches, _text(R.NOT_MAPPED)))

    return (
        choose(_text("Google"), _text("Facebook"), 0),
        choose(_google(fqdn), _facebook(fqdn), 1),
    )


def classify_domain(df: DataFrame, fqdn: str = "fqdn") -> DataFrame:
    """Add org and category. Rules run once per distinct name, then are joined back.

    Flows without a name, often most of them, are classified without the join; they get keys of
    their own in it, so they do not meet in one task.
    """
    named = F.coalesce(F.col(fqdn), F.lit("")) != ""
    names = df.where(named).select(F.col(fqdn).alias("_name")).distinct()
    org, category = domain_class("_name")
    known = names.select("_name", org.alias("_org"), category.alias("_category"))
    other = [c for c in df.columns if c not in ("org", "category")]
    spread = F.concat(F.lit(" "), F.xxhash64(*other).cast("string"))
    return (
        df.select(*other)
        .withColumn("_name", F.when(named, F.col(fqdn)).otherwise(spread))
        .join(known, "_name", "left")
        .select(*other, F.when(named, F.col("_org")).otherwise(R.NO_DNS).alias("org"),
                F.when(named, F.col("_category")).otherwise(R.NO_DNS).alias("category"))
    )


def _address_test(ip: str, how: str, texts) -> str:
    return "(" + " OR ".join(f"{how}({ip}, {_text(t)})" for t in texts) + ")"


def address_class(ip: str) -> tuple[Column, Column]:
    """(organisation, category) of the address in column ``ip``."""
    tests = [_address_test(ip, how, texts) for _, _, how, texts in R.ADDRESS_RULES]

    def choose(column: int) -> Column:
        results = [_text(rule[column]) for rule in R.ADDRESS_RULES]
        return F.expr(_case(list(zip(tests, results)), _text(R.NO_DNS)))

    return choose(0), choose(1)


def classify_ip(df: DataFrame, ip: str = "dest_ip") -> DataFrame:
    org, category = address_class(ip)
    return df.withColumns({"org": org, "category": category})


def protocol_name(protocol: str, port: str) -> Column:
    by_protocol = []
    for number, ports in R.PORT_NAMES.items():
        named = [(f"{port} = {p}", _text(name)) for p, name in ports.items()]
        by_protocol.append((f"{protocol} = {number}", _case(named, _text(R.OTHER_PORTS[number]))))
    return F.expr(_case(by_protocol, _text(R.OTHER_PROTOCOL)))


def is_call_setup(protocol: str = "protocol", port: str = "dest_port") -> Column:
    return (F.col(protocol) == 17) & (F.col(port) == 3478)


def classify_flows(flows: DataFrame, per_name: bool = True) -> DataFrame:
    """Name first, then the call-setup port, then Facebook's addresses, then the local flag.

    Without ``per_name`` the rules run on every row, as they must on a stream.
    """
    if per_name:
        by_name = classify_domain(flows)
    else:
        org, category = domain_class("fqdn")
        by_name = flows.withColumns({"org": org, "category": category})
    facebook_ip = F.expr(_any_of("dest_ip", R.ADDRESS_RULES[0][3]))
    by_port = by_name.withColumn(
        "category", F.when(is_call_setup(), R.ICE).otherwise(F.col("category"))
    )
    by_address = by_port.withColumns(
        {
            "org": F.when((F.col("org") == R.NO_DNS) & facebook_ip, "Facebook").otherwise(
                F.col("org")
            ),
            "category": F.when(
                (F.col("category") == R.NO_DNS) & facebook_ip, R.NOT_MAPPED
            ).otherwise(F.col("category")),
        }
    )
    return mark_local(by_address, "dest_ip", "local")


def classify_remaining_by_ip(flows: DataFrame) -> DataFrame:
    """Fill what is still without DNS from the address rules; runs after the call trace."""
    org, category = address_class("dest_ip")
    return flows.withColumns(
        {
            "category": F.when(F.col("category") == R.NO_DNS, category).otherwise(
                F.col("category")
            ),
            "org": F.when(F.col("org") == R.NO_DNS, org).otherwise(F.col("org")),
        }
    )


def k_anonymize(
    df: DataFrame,
    key: str = "org",
    user: str = "user_id",
    k: int = 5,
    label: str = R.ANONYMIZED_ORG,
    ignore_zero: str | None = None,
) -> DataFrame:
    """Relabel values of ``key`` seen with fewer than ``k`` distinct users.

    Users are dealt to slots by a hash; the least and greatest user of a slot show up to two of its
    users, so a value with ``k`` of them in all its slots has ``k`` users. Only the rows of the values
    left, which nearly always have few users, are counted by user.

    The report variant counts only rows whose ``ignore_zero`` column is not zero; a value with
    no such row keeps its name, as there.
    """
    counted = df.where(F.col(ignore_zero) != 0) if ignore_zero else df
    counted = counted.select(key, F.col(user).alias("_user"))
    slots = counted.groupBy(key, F.pmod(F.xxhash64("_user"), F.lit(4 * k)).alias("_slot")).agg(
        F.min("_user").alias("_least"), F.max("_user").alias("_most")
    )
    # null for a slot of rows without a user
    shown = F.coalesce(F.lit(1) + (F.col("_least") != F.col("_most")).cast("int"), F.lit(0))
    open_keys = slots.groupBy(key).agg(F.sum(shown).alias("_shown")).where(F.col("_shown") < k).select(key)
    rare = (
        counted.join(open_keys, key, "left_semi")
        .groupBy(key)
        .agg(F.count_distinct("_user").alias("_users"))
        .where(F.col("_users") < k)
        .select(key, F.lit(True).alias("_rare"))
    )
    return (
        df.join(rare, key, "left")
        .withColumn(key, F.when(F.col("_rare"), F.lit(label)).otherwise(F.col(key)))
        .select(*df.columns)
    )
