"""All registered queries on trajectories and fields, and the DuckDB SQL that each must equal.

A query's columns are given as "strings | integers | doubles"; both sides cast integers to bigint and round doubles to 8 decimals.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import CTES, NEEDS, Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DIGITS = 8
#: Added before rounding, so that exact halves, which sums in another order may miss by a bit, are no ties.
OFF_TIES = 3.3e-10


def also(name: str, known: str) -> None:
    """A second name of a registered query."""
    QUERIES[name] = QUERIES[known]
    if known in ORACLES:
        ORACLES[name] = ORACLES[known]


def register(name: str, columns: str, query: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    texts, whole, real = (part.split() for part in columns.split("|"))

    def run(spark, sf_dir: str) -> DataFrame:
        df = query(Views(spark, sf_dir))
        return df.select(*texts, *[F.col(c).cast("long").alias(c) for c in whole], *[(F.round(F.col(c).cast("double") + OFF_TIES, DIGITS) + F.lit(0.0)).alias(c) for c in real])

    QUERIES[name] = run
    if sql:
        used: list[str] = []

        def need(text: str) -> None:
            for c in CTES:
                if re.search(rf"\b{c}\b", text) and c not in used:
                    for d in NEEDS.get(c, ()):
                        need(d)
                    if c not in used:
                        used.append(c)

        need(sql)
        used.sort(key=list(CTES).index)
        own = re.match(r"\s*with\s+(recursive\s+)?", sql)
        ctes = ", ".join(f"{c} as ({CTES[c]})" for c in used)
        shape = ", ".join([*texts, *[f'"{c}"::bigint as "{c}"' for c in whole], *[f'round("{c}"::double + {OFF_TIES}, {DIGITS}) + 0.0 as "{c}"' for c in real]])
        if own:
            body = sql[own.end() :]
            inner = f"with {own.group(1) or ''}{ctes + ', ' if ctes else ''}{body}"
        else:
            inner = f"with {ctes} {sql}" if ctes else sql
        ORACLES[name] = f"select {shape} from ({inner}) as result"


from . import composed, fields, lags, more, spread, states, stored, tracks  # noqa: E402, F401
