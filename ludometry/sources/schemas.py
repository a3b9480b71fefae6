"""Canonical table schemas and column checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_S, _D, _I, _F, _L = T.StringType(), T.DateType(), T.IntegerType(), T.DoubleType(), T.LongType()

PLAYERS = _schema(
    player_id=_S,
    install_date=_D,
    last_active_date=_D,
    platform=_S,
    country=_S,
    gender=_S,
    age=_I,
    fb_connected=_I,
    tutorial_completed=_I,
    total_sessions=_I,
    avg_session_minutes=_F,
    total_play_hours=_F,
    days_active=_I,
    max_stage_reached=_I,
    d1_retained=_I,
    d7_retained=_I,
    d30_retained=_I,
    is_payer=_I,
    total_spend_usd=_F,
    num_purchases=_I,
    days_to_first_purchase=_F,
    churned_d7=_I,
    player_tier=_S,
)

TRANSACTIONS = _schema(
    transaction_id=_S,
    player_id=_S,
    transaction_date=_D,
    item_name=_S,
    item_category=_S,
    price_usd=_F,
    platform=_S,
    country=_S,
)

AB_UNITS = _schema(userid=_L, version=_S, sum_gamerounds=_I, retention_1=_I, retention_7=_I)


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` if it has all the columns; an error that names the missing ones otherwise."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
