"""Date columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mixed_date(c: Column) -> Column:
    """Date from ``yyyy-mm-dd`` or ``d/m/yyyy`` text; anything else, impossible days included, is null."""
    t = F.trim(c)
    ymd = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t)
    dmy = F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"))
    return F.coalesce(ymd, dmy).try_cast("date")
