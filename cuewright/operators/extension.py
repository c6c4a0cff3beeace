"""Extension points: scorers of windows and answer providers. A scorer's arrays travel in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .answers import union_answers

#: Scorers that this Python worker has loaded, by name.
held: dict[str, Callable] = {}

#: A window's score and probabilities, added to its columns.
SCORED = "score double, probs array<double>"


def score_with(windows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], name: str | None = None) -> DataFrame:
    """Adds score and probs. `load` returns a function from a batch of windows to those two columns.

    With a `name`, which stands for one model and version, `load` runs once in every Python worker, which serves many
    tasks; without, once in every task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from cuewright.operators import extension  # the module that the worker holds, not a copy that came with the task

        if name is None:
            scorer = load()
        else:
            scorer = extension.held[name] = extension.held.get(name) or load()
        for batch in batches:
            yield pd.concat([batch.reset_index(drop=True), scorer(batch)[["score", "probs"]].reset_index(drop=True)], axis=1)

    return windows.mapInPandas(run, StructType([*windows.schema.fields, *StructType.fromDDL(SCORED).fields]))


def answer_with(clips: DataFrame, providers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Answers of all providers: each takes the clips and returns an answers frame with its provider's name."""
    return union_answers(*(p(clips) for p in providers))
