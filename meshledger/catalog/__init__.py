"""Every registered query with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from meshledger.catalog import classes, coverage, ledgers, money, shaping, sources, streams, traffic, users

_PARTS = (sources, shaping, traffic, users, money, ledgers, classes, coverage, streams)


def queries():
    return {name: run for part in _PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, (_, sql) in part.QUERIES.items() if sql}
