"""Calls to an embedding provider from within tasks: several at once, held to a rate, and an error for a row instead of a failed job."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]


class Pace:
    """Lets callers pass at most ``per_second`` times a second, evenly; shared by the threads of a task."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep = 1 / per_second if per_second else 0.0, clock, sleep
        self.next, self.lock = 0.0, threading.Lock()

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def called(provider: Provider, texts: list[str], size: int, pace: Pace, tries: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text. A call that fails is tried again, then halved, so that only the texts it fails for have errors."""
    why = ""
    for _ in range(tries):
        pace.wait()
        try:
            vectors = provider(texts)
        except Exception as e:  # noqa: BLE001  whatever a provider raises belongs to its rows
            why = type(e).__name__
            continue
        if len(vectors) != len(texts):
            why = "count"
            continue
        return [(list(map(float, v)), None) if v is not None and len(v) == size else (None, "dimension" if v is not None and len(v) else "empty") for v in vectors]
    if len(texts) == 1:
        return [(None, why)]
    half = len(texts) // 2
    return called(provider, texts[:half], size, pace, tries) + called(provider, texts[half:], size, pace, tries)


def embed_guarded(df: DataFrame, text: str, size: int, provider: Provider, batch: int = 32, at_once: int = 4, per_second: float | None = None, tries: int = 2) -> DataFrame:
    """Add ``embedding`` and ``embedding_error``; one of them is null in each row.

    Each task keeps ``at_once`` calls of ``batch`` texts going and starts no more than ``per_second`` calls a second, so a
    limit for the whole service is this rate times the tasks that run at once. Errors are the class of what the provider raised,
    or count, dimension or empty; its messages may hold parts of requests and are not kept. Blank and null texts
    are not sent and have the error ``blank``.
    """

    @F.pandas_udf("embedding array<float>, error string")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)
        with ThreadPoolExecutor(at_once) as pool:
            for texts in columns:
                out: list[tuple] = [(None, "blank")] * len(texts)
                said = [i for i, t in enumerate(texts) if t is not None and t.strip()]
                parts = [said[k : k + batch] for k in range(0, len(said), batch)]
                for part, found in zip(parts, pool.map(lambda part, texts=texts: called(provider, [texts.iloc[i] for i in part], size, pace, tries), parts), strict=True):
                    for i, result in zip(part, found, strict=True):
                        out[i] = result
                yield pd.DataFrame(out, columns=["embedding", "error"])

    name = "_made"
    while name in df.columns:
        name = f"_{name}"
    done = df.withColumn(name, vectors(F.col(text)))
    return done.withColumn("embedding", F.col(name)["embedding"]).withColumn("embedding_error", F.col(name)["error"]).drop(name)
