"""Sentences of pages as they arrive, each with the one before it and what it stands for: keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from quantspark.operators.coreference import BACK_ENDS, clusters
from quantspark.session import ship

OUTPUT = "page_id long, sent_idx long, sentence string, previous string, mentions array<struct<start:int,end:int>>"
_STATE = "sent_idx long, sentence string"


def _step(back_end: str, idle_ms: int | None):
    """One page's new sentences against the last one kept; a page that has been idle for ``idle_ms`` has ended."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(rows)).sort_values("sent_idx", kind="stable")
        before = state.get[1] if state.exists else None
        out = []
        for index, sentence in zip(batch["sent_idx"].tolist(), batch["sentence"].tolist(), strict=True):
            out.append((key[0], index, sentence, before, _mentions(before, sentence, back_end)))
            before = sentence
        state.update((int(batch["sent_idx"].iloc[-1]), before))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["page_id", "sent_idx", "sentence", "previous", "mentions"])

    return run


def _mentions(previous: str | None, sentence: str | None, back_end: str) -> list[dict[str, int]]:
    """Phrases of the sentence that stand for something in the one before."""
    if not previous or not sentence:
        return []
    shift = len(previous) + 1
    found = BACK_ENDS.get(back_end, clusters)(previous, sentence)
    return [{"start": a - shift, "end": b - shift} for c in found if any(m[0] < shift for m in c) for a, b in sorted(c) if a >= shift]


def with_context(sentences: DataFrame, back_end: str = "head_noun", idle_ms: int | None = None) -> DataFrame:
    """``sentences`` (page_id, sent_idx, sentence), a stream, with ``previous`` and ``mentions``.

    Sentences of a page must arrive in order, in one batch or in many: a batch's own are sorted, and the last one is kept
    for the next batch, in a state that grows with the pages at hand, not with their lengths. With
    ``idle_ms`` a page that has been idle so long has ended, and its state goes; such a query wakes up for its timers, so
    it needs a trigger by time and doesn't end with ``availableNow``.
    """
    ship(sentences.sparkSession)
    keyed = sentences.select("page_id", sentences["sent_idx"].cast("long").alias("sent_idx"), "sentence").groupBy("page_id")
    return keyed.applyInPandasWithState(_step(back_end, idle_ms), OUTPUT, _STATE, "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
