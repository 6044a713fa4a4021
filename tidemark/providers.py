"""Contracts of what a deployment injects, and deterministic stand-ins for tests."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.streaming.stateful import Splitter


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row per text."""


class Recogniser(Protocol):
    def recognise(self, image: bytes) -> list[dict]:
        """Word spans with text and geometry."""


class Tagger(Protocol):
    def describe(self, image: bytes) -> str:
        """A reply for ``functions.scalars.reply_struct``."""


class Answerer(Protocol):
    def answer(self, question: str, context: list[tuple[int, str]]) -> Iterator[str]:
        """The pieces of a reply to a question, grounded on ``(frame_id, text)`` rows."""


def answer_deltas(provider: Answerer, question: str, context: list[tuple[int, str]], cancelled: Callable[[], bool] = lambda: False) -> Iterator[tuple[str, object]]:
    """A reply as ordered deltas: thinking and spoken pieces, then the frames it was grounded on, then how it ended."""
    splitter = Splitter()
    try:
        pieces = provider.answer(question, context)
        for piece in pieces:
            for thinking, text in splitter.push(piece):
                if cancelled():
                    yield "cancelled", None
                    return
                yield "thinking" if thinking else "token", text
        if cancelled():
            yield "cancelled", None
            return
        yield from (("thinking" if thinking else "token", text) for thinking, text in splitter.push("", last=True))
    except Exception as e:  # what a provider raises is the user's to see, whatever it is
        yield "error", str(e)
        return
    yield from (("citation", i) for i, _ in context)
    yield "done", None


class Asks:
    """Answers that run under an id. A new one under the same id takes the place of the one before, which is cancelled."""

    def __init__(self):
        self._turn, self._running = threading.Lock(), {}

    def start(self, request: str, deltas: Callable[[Callable[[], bool]], Iterator[tuple[str, object]]]) -> Iterator[tuple[str, str, object]]:
        """The deltas of an answer with its id; ``deltas`` gets what says whether it is cancelled."""
        own = object()
        with self._turn:
            self._running[request] = own

        def run() -> Iterator[tuple[str, str, object]]:
            try:
                for kind, what in deltas(lambda: self._running.get(request) is not own):
                    yield request, kind, what
            finally:
                with self._turn:
                    if self._running.get(request) is own:
                        del self._running[request]

        return run()

    def cancel(self, request: str) -> bool:
        """Whether an answer under the id was running; it gives no more pieces."""
        with self._turn:
            return self._running.pop(request, None) is not None


def interleaved(streams: Iterable[Iterator]) -> Iterator:
    """One piece of each stream in turn until all have ended."""
    open_ = list(streams)
    while open_:
        for stream in list(open_):
            try:
                yield next(stream)
            except StopIteration:
                open_.remove(stream)


class Collected:
    """A summariser from what only answers: the spoken pieces of an answer, and the frames that it cites, each once.

    The prompt is the question. What the answer's reasoning says isn't part of a summary; an error is raised.
    """

    def __init__(self, provider: Answerer, context_tokens: int = 0):
        self.provider, self.context_tokens = provider, context_tokens

    def summarise(self, prompt: str, texts: list[tuple[int, str]], reply_tokens: int) -> tuple[str, list[int]]:
        said, cited = [], {}
        for kind, what in answer_deltas(self.provider, prompt, texts):
            if kind == "token":
                said.append(what)
            elif kind == "citation":
                cited[what] = None
            elif kind == "error":
                raise RuntimeError(what)
        return "".join(said), list(cited)


class HashEmbedder:
    """Sums of fixed pseudo-random word vectors: equal texts get equal vectors."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        word = lambda w: np.random.default_rng(xxhash.xxh64_intdigest(w)).uniform(-1, 1, self.dimensions)
        return np.array([np.sum([word(w) for w in t.split()] or [np.zeros(self.dimensions)], axis=0) for t in texts], np.float32)


def embed(provider: Embedder, text: Column) -> Column:
    """A provider as a vectorised function of a text column."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(provider.embed(texts.fillna("").tolist())))

    return run(text)
