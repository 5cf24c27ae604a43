"""Generation piece by piece: stop strings that may span pieces, a clamp to the context, and a budget of requests a second."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import context_size, new_tokens
from .services import COMPLETION, Completions, Sampling


class Stops:
    """An automaton for a set of stop strings; its state goes along from piece to piece."""

    def __init__(self, stops: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.size = [0], [0]
        for stop in stops:
            if not stop:
                raise ValueError("an empty stop string would end every text")
            at = 0
            for c in stop:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.size.append(0)
                at = self.next[at][c]
            self.size[at] = len(stop)
        todo = deque(self.next[0].values())
        while todo:
            at = todo.popleft()
            for c, to in self.next[at].items():
                self.fail[to] = self.step(self.fail[at], c)
                # The longest stop that ends here.
                self.size[to] = self.size[to] or self.size[self.fail[to]]
                todo.append(to)

    def step(self, state: int, c: str) -> int:
        while state and c not in self.next[state]:
            state = self.fail[state]
        return self.next[state].get(c, 0)

    def feed(self, state: int, piece: str) -> tuple[int, int | None, int]:
        """(state after the piece, where in the piece the first stop ends, its length); (state, None, 0) if none ends in it."""
        for k, c in enumerate(piece):
            state = self.step(state, c)
            if self.size[state]:
                return state, k + 1, self.size[state]
        return state, None, 0


def assemble(pieces: Iterable[str], stops: Stops, most: int) -> tuple[str, str]:
    """(finish reason, text) of at most so many pieces, up to the stop string that is complete first; the rest is never asked for."""
    text, length, state = [], 0, 0
    source = iter(pieces)
    for _ in range(most):
        piece = next(source, None)
        if piece is None:
            return "eos_token", "".join(text)
        text.append(piece)
        state, end, size = stops.feed(state, piece)
        if end is not None:
            return "stop", "".join(text)[: length + end - size]
        length += len(piece)
    return ("eos_token" if next(source, None) is None else "length"), "".join(text)


@dataclass(frozen=True)
class Generator:
    """A local model in the place of a completion service: pieces gives a prompt's continuation, token by token.

    count gives a prompt's tokens; context is a number of tokens or a model family, by its infilling marks. A prompt that fills the context, or the most tokens that prompt and answer may have
    together, gives an error; no answer goes beyond either.
    """

    pieces: Callable[[str, int, Sampling], Iterable[str]]
    count: Callable[[Column], Column]
    context: int | str
    sampling: Sampling = Sampling()
    most: int | None = None

    def apply(self, rows: DataFrame, prompt: str = "prompt", seed: str = "seed_value") -> DataFrame:
        """rows with choices and error."""
        used = F.coalesce(self.count(F.col(prompt)), F.lit(0))
        context = context_size(self.context) if isinstance(self.context, str) else self.context
        asked = rows.withColumn("_room", new_tokens(context, used, self.sampling.max_tokens, self.most))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", choices {COMPLETION}, error string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            stops = Stops(self.sampling.stop)

            def one(text: str | None, number: int, room: int) -> tuple[list[dict] | None, str | None]:
                if text is None or room <= 0:
                    return None, "no prompt" if text is None else "the prompt fills the context"
                try:
                    found = [assemble(self.pieces(text, int(number) + k, self.sampling), stops, int(room)) for k in range(self.sampling.n)]
                except Exception as e:  # noqa: BLE001  a failed generation is a row with its error
                    return None, str(e)[:500]
                return [{"finish_reason": reason, "text": out} for reason, out in found], None

            for pdf in batches:
                found = [one(*x) for x in zip(pdf[prompt], pdf[seed], pdf["_room"], strict=True)]
                yield pdf.drop(columns="_room").assign(choices=[f[0] for f in found], error=[f[1] for f in found])

        return asked.mapInPandas(run, schema)


class Bucket:
    """Hands out turns at a rate; threads that ask at once wait one after the other."""

    def __init__(self, per_second: float, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.now, self.sleep = 1.0 / per_second, now, sleep
        self.next, self.lock = now(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            at = max(self.now(), self.next)
            self.next = at + self.gap
        wait = at - self.now()
        if wait > 0:
            self.sleep(wait)


@dataclass(frozen=True)
class Limited(Completions):
    """Completions under one budget of requests a second for the whole stage, however large the cluster.

    The rows are dealt evenly to ``tasks`` partitions, so no more tasks run at once, and each has an equal part of the budget. A
    task's first request waits for a part of its gap, so that tasks which start together do not ask together. Retries take turns too.
    """

    per_second: float = 10.0
    tasks: int = 4

    def apply(self, rows: DataFrame, prompt: str = "prompt", seed: str = "seed_value") -> DataFrame:
        from pyspark import TaskContext

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", choices {COMPLETION}, error string"
        share = self.per_second / self.tasks

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = TaskContext.get()
            bucket = Bucket(share)
            bucket.next += bucket.gap * ((context.partitionId() if context else 0) % self.tasks + 1) / self.tasks

            def turn(text: str, number: int, sampling: Sampling) -> list[tuple[str, str]]:
                bucket.take()
                return self.complete(text, number, sampling)

            plain = Completions(turn, self.sampling, self.in_flight, 0.0, self.retry)
            with ThreadPoolExecutor(self.in_flight) as pool:
                for pdf in batches:
                    found = list(pool.map(plain._one, pdf[prompt], pdf[seed]))
                    yield pdf.assign(choices=[f[0] for f in found], error=[f[1] for f in found])

        return rows.repartition(self.tasks).mapInPandas(run, schema)
