"""Search plans, and what prompts ask for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Results at most.
RESULT_CAP = 1000


@dataclass(frozen=True)
class SearchPlan:
    """What a search asks for; None and empty ask for nothing."""

    industry: str | None = None
    states: tuple[str, ...] = ()
    size_min: int | None = None
    size_max: int | None = None
    roles: tuple[str, ...] = ()
    max_results: int | None = None

    def target(self) -> int:
        return min(RESULT_CAP, self.max_results or RESULT_CAP)

    def query_budget(self) -> int:
        """Queries that a search may issue: twice its target, within 8 and the cap."""
        return min(RESULT_CAP, max(8, 2 * self.target()))


def parse_prompts(prompts: DataFrame, column: str) -> DataFrame:
    """The prompts with max_results, size_min, size_max and place, each null where the text does not say."""
    text = F.coalesce(F.col(column), F.lit(""))
    number = lambda pattern, i=1: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("int")
    span = r"(?i)(?:company size|employees?|size)[^0-9]{0,12}([0-9]{1,6})\s*(?:-|–|to)\s*([0-9]{1,6})"
    return prompts.select(
        "*", F.least(F.lit(RESULT_CAP), number(r"(?i)\b(?:find|list|get|show)(?:\s+me)?(?:\s+up\s+to)?\s+([0-9]{1,6})\b")).alias("max_results"), number(span).alias("size_min"), number(span, 2).alias("size_max"),
        F.nullif(F.regexp_extract(text, r"\bin ([A-Z][a-z]+(?: [A-Z][a-z]+)?)", 1), F.lit("")).alias("place"),
    )
