"""Which variables of an environment hold secrets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .secrets import ENV_LEAST

# --- fixed values: name parts that say credential, in any place and at the end only ---
ANYWHERE = ("TOKEN", "SECRET", "PASSWORD", "PASSWD", "PASSPHRASE", "CREDENTIAL", "CREDENTIALS", "APIKEY")
AT_END = ("KEY", "PWD", "PASS", "AUTH", "PAT")


def is_credential_name(name: str) -> bool:
    parts = name.upper().replace("-", "_").split("_")
    return any(p in ANYWHERE for p in parts) or parts[-1] in AT_END and len(parts) > 1


def known_values(environment: Mapping[str, str], extra: Iterable[str] = ()) -> dict[str, str]:
    """Name to value of the variables to redact: credential-shaped names and extra ones, with values long enough to tell."""
    names = {n for n in environment if is_credential_name(n)} | (set(extra) & set(environment))
    return {n: environment[n] for n in sorted(names) if len(environment[n]) >= ENV_LEAST}


def is_credential_column(name: Column) -> Column:
    """Native form of is_credential_name()."""
    parts = F.split(F.upper(F.replace(name, F.lit("-"), F.lit("_"))), "_")
    return F.arrays_overlap(parts, F.array(*map(F.lit, ANYWHERE))) | (F.element_at(parts, -1).isin(*AT_END) & (F.size(parts) > 1))
