"""What a line of job output says: progress and the id of the job it started."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line endings that carry progress or a job id, tried in this order.
# \z rather than $ so that a line with a trailing newline does not match.
PROGRESS_PATTERNS = (r" map \d+%\s+reduce \d+%\z", r" \d+% complete\z")
CHILD_ID_PATTERNS = (r" Running job: (\S+)\z", r" HadoopJobId: (\S+)\z")


def _first_match(line: Column | str, patterns: tuple[str, ...], group: int) -> Column:
    found = [F.nullif(F.regexp_extract(line, p, group), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def parse_progress(line: Column | str) -> Column:
    """The progress text at the end of the line, such as ``50% complete``; else null."""
    return F.trim(_first_match(line, PROGRESS_PATTERNS, 0))


def parse_child_id(line: Column | str) -> Column:
    """The id of the job the line says was started; else null."""
    return _first_match(line, CHILD_ID_PATTERNS, 1)
