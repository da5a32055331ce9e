"""Named queries, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from cadenza.plans import channel, data, examples, gaps, joins, metrics, packing, replay, scans, serving, turns, waves

MODULES = (turns, gaps, examples, joins, packing, waves, channel, metrics, data, scans, serving, replay)


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
