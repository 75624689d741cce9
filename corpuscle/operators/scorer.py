"""Model inference behind one protocol: a function from texts to JSON replies, called in batches with retries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpuscle.plans.ship import ship

#: Replies to a list of prompts, in order.
Scorer = Callable[[list[str]], list[str]]


def scored(prompts: DataFrame, scorer: Scorer, batch: int = 30, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(id, reply, error) of prompts (id, prompt): null reply and the error's text where all tries failed."""
    ship(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                ids, texts = rows.column(0).slice(a, batch), rows.column(1).slice(a, batch).to_pylist()
                replies, error = [None] * len(texts), None
                for k in range(tries):
                    try:
                        replies, error = scorer(texts), None
                        break
                    except Exception as e:  # a model's failure is data here, not a failed job
                        error = f"{type(e).__name__}: {e}"
                        time.sleep(pause * 2**k if k + 1 < tries else 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(replies, pa.string()), pa.array([error] * len(texts), pa.string())], names=["id", "reply", "error"])

    return prompts.select("id", "prompt").mapInArrow(run, f"id {prompts.schema['id'].dataType.simpleString()}, reply string, error string")


def offline(texts: list[str]) -> list[str]:
    """A stand-in without a model: verdicts by simple rules, so that pipelines run anywhere."""
    return [f'{{"valid": {str(len(t) >= 40).lower()}, "confidence": {min(1.0, len(t) / 1000):.3f}, "words": {len(t.split())}}}' for t in texts]
