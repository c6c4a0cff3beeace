"""Copyright verdicts from the authors' life dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM, LIFESPAN = 70, 100


def verdict(a: Column, partial_set: Column, now: Column, term: int = TERM, lifespan: int = LIFESPAN) -> dict[str, Column]:
    """latest_author_death_year, authors_complete, public_domain, pd_presumption of an array of authors.

    authors: array of structs with birth_year and death_year. Protected while the latest known death is within the
    term; undetermined (null) if authors may be missing; else free. The presumption looks at authors without a
    death: free if even the youngest, at the presumed lifespan, died longer ago than the term."""
    some = F.size(a) > 0
    latest = F.array_max(F.transform(a, lambda x: x["death_year"]))
    complete = some & ~F.exists(a, lambda x: x["death_year"].isNull())
    partial = F.coalesce(partial_set, F.lit(False))
    known = latest.isNotNull()
    domain = F.when(known & (now - latest <= term), F.lit(False)).when(partial | ~complete | ~known, F.lit(None).cast("boolean")).otherwise(F.lit(True))
    unknown = F.filter(a, lambda x: x["death_year"].isNull())
    unsure = partial | (F.size(unknown) <= 0) | F.exists(unknown, lambda x: x["birth_year"].isNull()) | (known & (now - latest <= term))
    youngest = F.array_max(F.transform(unknown, lambda x: x["birth_year"]))
    presumed = F.when(~unsure, now - youngest > term + lifespan)
    return {"latest_author_death_year": F.when(some, latest), "authors_complete": F.coalesce(complete, F.lit(False)), "public_domain": F.when(some, domain), "pd_presumption": F.when(some, presumed)}


def rights_verdict(df: DataFrame, authors_col: str, partial_col: str, as_of_year: Column | int, term: int = TERM, lifespan: int = LIFESPAN) -> DataFrame:
    """Adds the columns of `verdict`."""
    now = F.lit(as_of_year) if isinstance(as_of_year, int) else as_of_year
    return df.withColumns(verdict(F.col(authors_col), F.col(partial_col), now, term, lifespan))


def rights_label(verdict: DataFrame) -> DataFrame:
    """Adds label, free_from_year and reason to a table with the verdict's columns (and has_authors)."""
    dead = F.col("latest_author_death_year")
    label = F.when(~F.col("has_authors"), F.lit(None)).when(F.col("public_domain"), "Public domain").when(~F.col("public_domain"), "Protected").otherwise("Unverified")
    reason = (F.when(~F.col("has_authors"), "no_authors").when(F.col("public_domain"), "all_dead_long_enough").when(~F.col("public_domain"), "died_within_term")
              .when(F.col("pd_presumption"), "presumed_free").when(F.col("pd_presumption") == False, "too_young_to_presume").otherwise("dates_missing"))  # noqa: E712
    return verdict.withColumns({"label": label, "free_from_year": dead + TERM + 1, "reason": reason})
