"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold a QUERY (name, function) and perhaps an ORACLE_SQL.
MODULES = ("pieces_viterbi", "media", "substrings", "packing", "langid", "quality_rules", "quality_lm", "pii", "minhash", "suffixes")


def queries() -> dict:
    return {name: f for m in MODULES for name, f in [import_module(f"{__package__}.{m}").QUERY]}


def oracle_sql() -> dict[str, str]:
    found = (import_module(f"{__package__}.{m}") for m in MODULES)
    return {m.QUERY[0]: m.ORACLE_SQL for m in found if getattr(m, "ORACLE_SQL", None)}
