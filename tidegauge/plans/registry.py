"""Registry of named queries and their SQL twins."""

import importlib
import re

QUERIES = {}
SQL = {}

MODULES = (
    "windows", "predicates", "frames", "sequences", "calibration", "ranking", "baselines", "aggregates", "graph_joins", "design", "scalars", "jobs", "sources_plans", "streams",
)


def expand(sql):
    """Write ``R<d>(x)`` in a twin out as the half-up rounding of `fixed`."""
    while True:
        hit = re.search(r"\bR(\d)\(", sql)
        if not hit:
            return sql
        depth, end = 1, hit.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body, unit = sql[hit.end() : end - 1], f"1e{hit.group(1)}"
        sql = f"{sql[:hit.start()]}(floor(({body}) * {unit} + 0.5) / {unit}){sql[end:]}"


def query(name, sql=None):
    """Register ``fn(tables) -> DataFrame`` under a name, with optional SQL."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return register


def load_all():
    for module in MODULES:
        importlib.import_module(f"tidegauge.plans.{module}")
    return QUERIES, SQL
