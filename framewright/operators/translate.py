"""Translation by a hook: when a query is translated, and whole tables text by text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """Whether vector queries are translated: by default, or as a request forces.

    Without a translator a request that asks for translation is an error; one that
    leaves it to the default is searched as it is.
    """

    translator: Callable[[str], str] | None = None
    by_default: bool = True

    def __call__(self, query: str, forced: bool | None = None) -> str:
        if not (self.by_default if forced is None else forced):
            return query
        if self.translator is None:
            if forced:
                raise RuntimeError("no translator is set up")
            return query
        return self.translator(query)


def translated(rows: DataFrame, text: str, name: str, batch: Callable[[list[str]], list[str]], one: Callable[[str], str] | None = None) -> DataFrame:
    """rows with ``name``, the translation of their text: distinct texts are translated once, batch by batch.

    Where a batch fails or answers with another number of texts, its texts are
    translated one by one; a text that fails stays as it is, as do nulls and
    blanks.
    """

    def single(t: str) -> str:
        try:
            return (one or (lambda x: batch([x])[0]))(t)
        except Exception:  # whatever a model raises costs its own text alone
            return t

    def run(batches):
        for pdf in batches:
            texts = pdf["__text"].tolist()
            try:
                found = batch(texts)
            except Exception:  # as above
                found = []
            yield pd.DataFrame({"__text": texts, name: found if len(found) == len(texts) else [single(t) for t in texts]})

    keyed = rows.select(F.col(text).alias("__text")).where(F.trim("__text") != "").distinct()
    answers = keyed.mapInPandas(run, f"__text string, {name} string")
    return rows.join(answers, F.col(text) == F.col("__text"), "left").select(*rows.columns, F.coalesce(name, text).alias(name))
