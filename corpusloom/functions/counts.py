"""Numbers of teams and runs that an overview claims."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WINDOW_CHARS = 15_000
MOST_PLAUSIBLE = 999
MOST_PAPERS_PER_TEAM = 1.5
TEAM_PATTERNS = (
    r"(\d+)\s+participating\s+teams",
    r"received\s+(?:results|submissions)\s+(?:coming\s+)?from\s+(\d+)\s+(?:distinct\s+|different\s+)?teams",
    r"(\d+)\s+distinct\s+teams",
    r"(\d+)\s+participating\s+groups",
    r"(\d+)\s+teams\s+(?:actively\s+)?participat\w*",
    r"(\d+)\s+teams\s+submitted",
    r"total\s+of\s+(\d+)\s+teams",
    r"(\d+)\s+teams\b(?!\s*(?:registered|up\b))",
)
RUN_PATTERNS = (
    r"total\s+of\s+(\d+)\s+(?:valid\s+)?runs",
    r"(\d+)\s+valid\s+runs",
    r"(\d+)\s+runs\s+(?:were\s+)?submitted",
    r"(?<!up to )(\d+)\s+runs\b",
    r"(?<!up to )(\d+)\s+approaches",
)
RUNS_PER_TASK = r"(\d+)\s+runs\s+for\s+(?:the\s+)?(?:task\s*\d+|\w+\s+task)"
_SECOND_HEADING = r"(?sU)\A(.*?)\n0*(?:[2-9]|[1-9]\d+)\.\s+\S"


def opening(text: Column) -> Column:
    """Abstract and introduction: up to the first heading numbered 2 or more, else a fixed length."""
    return F.when(text.rlike(_SECOND_HEADING), F.regexp_extract(text, _SECOND_HEADING, 1)).otherwise(F.substring(text, 1, WINDOW_CHARS))


def plausible(text: Column, pattern: str) -> Column:
    """All plausible numbers that a pattern finds, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(1)), lambda n: n.try_cast("int"))
    return F.filter(found, lambda n: n.between(1, MOST_PLAUSIBLE))


def first_count(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first plausible number of the first pattern that has one."""
    return F.coalesce(*[F.get(plausible(text, p), 0) for p in patterns])


def team_count(text: Column, n_papers: Column) -> Column:
    """Claimed teams; null where more papers per team than plausible show a misreading."""
    teams = first_count(opening(text), TEAM_PATTERNS)
    return F.when(n_papers / teams > MOST_PAPERS_PER_TEAM, F.lit(None)).otherwise(teams)


def run_count(text: Column) -> Column:
    """Claimed runs: the sum of a breakdown by task if there is one, else the first total."""
    window = opening(text)
    parts = plausible(window, RUNS_PER_TASK)
    return F.when(F.size(parts) >= 2, F.aggregate(parts, F.lit(0), lambda a, b: a + b)).otherwise(first_count(window, RUN_PATTERNS))
