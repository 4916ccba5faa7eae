"""Status messages: JSON bodies, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfdelta.functions import status as S
from shelfdelta.schemas import STATUS_MESSAGE

_READ = STATUS_MESSAGE + ", _corrupt_record string"


def parsed(raw: DataFrame, body: str = "body") -> DataFrame:
    """Messages as columns plus ``problem``: null, ``unreadable`` or ``invalid``.

    ``data`` stays JSON text. A message without task id or with an unknown status
    is invalid; both kinds are set aside, neither is retried.
    """
    kept = [c for c in raw.columns if c != body]
    message = F.from_json(F.col(body), _READ, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select(*kept, F.col(body), message.alias("m"))
    unreadable = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    invalid = F.col("m.task_id").isNull() | ~F.coalesce(S.is_known(F.col("m.status")), F.lit(False))
    fields = [f.split()[0] for f in STATUS_MESSAGE.replace("\n", " ").split(",")]
    return rows.select(*kept, body, *[F.col(f"m.{f}").alias(f) for f in fields],
                       F.when(unreadable, "unreadable").when(invalid, "invalid").alias("problem"))


def good(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("problem").isNull()).drop("problem", "body")


def quarantined(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("problem").isNotNull())
