"""Attendance statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attendance statuses.
STATUSES = ("PRESENT", "ABSENT", "LATE", "EXCUSED")
ATTENDED = ("PRESENT", "LATE")


def attended(status: Column) -> Column:
    """Present or late; NULL counts as not attended."""
    return F.coalesce(status.isin(*ATTENDED), F.lit(False))


def excused(status: Column) -> Column:
    return F.coalesce(status == "EXCUSED", F.lit(False))
