"""Pluggable judge: call a user function on request partitions and collect result records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

RESULT = "model_name string, response string, audio_path string, prompt string, error boolean"


def run_judge(
    requests: DataFrame,
    open_judge: Callable[[], Callable[[list[str], list[str]], list]],
    model_name: str,
    keys: tuple[str, ...] = ("item_id",),
    batch: int = 100,
    partitions: int | None = None,
) -> DataFrame:
    """Judge ``(keys..., prompt, audio_path)`` rows.

    ``open_judge`` is called once per partition and returns ``judge(prompts, audio_paths) -> answers``. An answer
    that is an exception, or a call that raises, becomes a record with ``error`` set and ``Error: ...`` as its
    response; the other rows go on. If a whole batch raises, its rows are tried one at a time. A judge that returns
    fewer answers than prompts leaves the missing ones as error records; surplus answers are ignored. ``partitions``
    deals the requests anew before the calls.
    """
    types = dict(requests.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + RESULT

    def call(judge, prompts: list[str], paths: list[str]) -> list:
        try:
            answers = list(judge(prompts, paths))[: len(prompts)]
            return answers + [ValueError("no answer")] * (len(prompts) - len(answers))
        except Exception as error:  # noqa: BLE001 - failures are data here
            if len(prompts) == 1:
                return [error]
            return [a for p, w in zip(prompts, paths) for a in call(judge, [p], [w])]

    def work(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = open_judge()
        for block in blocks:
            prompts, paths = block["prompt"].tolist(), block["audio_path"].tolist()
            answers: list = []
            for i in range(0, len(prompts), batch):
                answers += call(judge, prompts[i : i + batch], paths[i : i + batch])
            failed = [isinstance(a, Exception) for a in answers]
            out = block[list(keys)].copy()
            out["model_name"] = model_name
            out["response"] = [f"Error: {a}" if bad else str(a) for a, bad in zip(answers, failed)]
            out["audio_path"] = paths
            out["prompt"] = prompts
            out["error"] = failed
            yield out

    rows = requests.select(*keys, "prompt", "audio_path")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(work, schema)
