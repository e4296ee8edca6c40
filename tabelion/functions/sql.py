"""The library's text and statistics functions for plain SQL: temporary functions with SQL bodies, which the optimizer sees through."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tabelion.functions.stats import Z
from tabelion.functions.text import _FROM, _TO

_PLAIN = f"regexp_replace(translate(t, '{_FROM}', '{_TO}'), '\\\\p{{Mn}}', '')"
_P, _SCALE = "(hits / CAST(n AS DOUBLE))", f"(1 + {Z * Z} / n)"
_CENTRE = f"({_P} + {Z * Z} / (2D * n)) / {_SCALE}"
_MARGIN = f"{Z} * sqrt({_P} * (1 - {_P}) / n + {Z * Z} / (4D * n * n)) / {_SCALE}"
#: name -> (arguments, type, body)
FUNCTIONS = {
    "sem_acentos": ("t STRING", "STRING", _PLAIN),
    "normalizado": ("t STRING", "STRING", f"trim(regexp_replace({_PLAIN.replace('(t,', '(lower(t),')}, '(?U)\\\\s+', ' '))"),
    "so_digitos": ("t STRING", "STRING", "regexp_replace(coalesce(t, ''), '[^0-9]', '')"),
    "primeiro_dado": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
    "dias_entre": ("a DATE, b DATE", "INT", "CASE WHEN datediff(b, a) >= 0 THEN datediff(b, a) END"),
    "proporcao": ("hits BIGINT, n BIGINT", "DOUBLE", "try_divide(CAST(hits AS DOUBLE), n)"),
    "wilson_inf": ("hits BIGINT, n BIGINT", "DOUBLE", f"CASE WHEN n > 0 THEN greatest(0D, {_CENTRE} - {_MARGIN}) END"),
    "wilson_sup": ("hits BIGINT, n BIGINT", "DOUBLE", f"CASE WHEN n > 0 THEN least(1D, {_CENTRE} + {_MARGIN}) END"),
}


def register(spark: SparkSession) -> None:
    """Makes them known to the session."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
