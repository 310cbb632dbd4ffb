"""Guards for graph query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Fixed values.
WRITE_WORDS = "CREATE DELETE DETACH REMOVE SET MERGE FOREACH DROP ALTER".split()
READ_WORDS = r"MATCH|OPTIONAL\s+MATCH|CALL|WITH|UNWIND|RETURN"
LEAST_LENGTH = 8


def is_readonly(q: Column) -> Column:
    """No writing word anywhere, not even in a string."""
    return ~F.coalesce(q, F.lit("")).rlike(rf"(?i)\b({'|'.join(WRITE_WORDS)})\b")


def preflight(q: Column) -> Column:
    """ok, or the class of the first fault: too short, writing, no reading clause, several statements."""
    s = strip(F.coalesce(q, F.lit("")))
    return (
        F.when(F.length(s) < LEAST_LENGTH, "参数错误")
        .when(~is_readonly(s), "安全拒绝")
        .when(~s.rlike(rf"(?i)\b({READ_WORDS})\b"), "语法预检")
        .when(s.rlike(r";\s*[^\s;]"), "语法预检")
        .otherwise("ok")
    )
