"""Batch standardisation: prompts for all legacy records, a pluggable standardiser, one output record for each."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_answers(standardised: DataFrame, template_check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Answers that are strict records, as the template check says."""
    return template_check(standardised).where(F.size("problems") == 0)


def run_batch(prompts: DataFrame, standardise: Callable[[str], str], at_once: int = 5) -> DataFrame:
    """(assay, record, value): standardise(prompt) of each row (assay, record, prompt), at_once partitions at a time.

    The callable talks to whatever model is used; an exception ends the job, as in a batch run that gathers results.
    """

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"assay": frame["assay"], "record": frame["record"], "value": frame["prompt"].map(standardise)})

    return prompts.repartition(at_once, "assay", "record").mapInPandas(run, "assay string, record string, value string")
