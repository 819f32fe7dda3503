"""The draw record and the small tables that configure the reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: numbers: ordered, the position is the prize. seq: order of ingestion, which
#: decides "first wins" ties.
DRAWS = T.StructType(
    [
        T.StructField("lottery", T.StringType(), False),
        T.StructField("draw", T.StringType(), False),
        T.StructField("draw_date", T.DateType(), False),
        T.StructField("numbers", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)
SLOT = ["draw_date", "lottery", "draw"]
#: Rank of sources that no prefix names.
LAST_RANK = 99


@dataclass(frozen=True)
class Dims:
    """Configuration as data, so that nothing below is tied to a country.

    ranks: (source prefix, rank), the first that fits. lotteries: in display
    order. visible: (lottery, draw). aliases: (normalised draw, draw). labels:
    (lottery, draw, label), in order. delay_labels: the same, matched exactly.
    start: the first day of the base analysis."""

    start: str
    ranks: tuple[tuple[str, int], ...] = ()
    lotteries: tuple[str, ...] = ()
    visible: tuple[tuple[str, str], ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()
    labels: tuple[tuple[str, str, str], ...] = ()
    delay_labels: tuple[tuple[str, str, str], ...] = ()
    slugs: tuple[tuple[str, str], ...] = field(default=())
