"""All queries of the engine by name, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package with QUERIES {name: function(spark, sf_dir)} and SQL {name: text}.
MODULES = ("journals", "volumes", "systems")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").SQL.items()}
