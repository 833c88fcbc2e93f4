"""Calendar helpers (D1-D7). The session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def epoch_to_date(c) -> Column:
    """Epoch seconds -> UTC calendar day."""
    return F.to_date(F.timestamp_seconds(col(c)))


def weekday0(c) -> Column:
    """D3: weekday number with Monday = 0 ... Sunday = 6."""
    return F.weekday(col(c))


def temporal_features(ts) -> dict[str, Column]:
    """Date, hour, English day name, month, weekend flag from a timestamp."""
    ts = col(ts)
    day_names = F.array(*[F.lit(n) for n in
                          ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")])
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day_name": F.element_at(day_names, F.weekday(ts) + 1),
        "month": F.month(ts),
        "is_weekend": F.weekday(ts) >= 5,
    }


def to_trading_day(c) -> Column:
    """Saturday -> Friday (-1), Sunday -> Friday (-2); holidays are not handled."""
    d = col(c)
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def days_between(later, earlier) -> Column:
    """Calendar days held."""
    return F.datediff(col(later), col(earlier))


def window_start(end, days: int = 30) -> Column:
    """Start of a look-back window of ``days`` calendar days."""
    return F.date_sub(col(end), days)
