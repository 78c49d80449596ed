"""Edges to outside services: language model, embeddings, registry. Each is a callable that a caller passes in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Seconds before each further try.
CHAT_DELAYS = (0.5, 1.0, 2.0, 4.0)
EMBED_DELAYS = (0.0, 0.5, 1.0, 2.0)


class Retry(Exception):
    """Raised by a service for a failure that may pass."""


def with_retries(call: Callable, delays=CHAT_DELAYS, sleep: Callable[[float], None] = time.sleep) -> Callable:
    def run(*args):
        for delay in delays:
            try:
                return call(*args)
            except Retry:
                sleep(delay)
        return call(*args)

    return run


#: Makers of chat clients by name; each gives a callable of a system text and a prompt.
_CLIENTS: dict[str, Callable[..., Callable[[str, str], str]]] = {}


def register_client(name: str, make: Callable[..., Callable[[str, str], str]]) -> None:
    """Names a kind of chat client: make(**settings) is called in each task, so that connections need not travel."""
    _CLIENTS[name] = make


def chat_client(name: str, **settings) -> Callable[[str, str], str]:
    """A chat callable for ask() that makes its client of the named kind where it is first used."""
    make, held = _CLIENTS[name], []

    def chat(system: str, prompt: str) -> str:
        if not held:
            held.append(make(**settings))
        return held[0](system, prompt)

    return chat


def ask(prompts: DataFrame, chat: Callable[..., str], delays=CHAT_DELAYS) -> DataFrame:
    """prompts (doc_id, prompt) with reply and error; a failed row keeps its error and the others go on.

    With a column `system`, chat is called with it and the prompt, else with the prompt alone."""
    columns = ["doc_id", "system", "prompt"] if "system" in prompts.columns else ["doc_id", "prompt"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(chat, delays)
        for frame in frames:
            replies, errors = [], []
            for said in frame[columns[1:]].itertuples(index=False):
                try:
                    replies.append(call(*said) or ""), errors.append(None)
                except Exception as e:  # noqa: BLE001
                    replies.append(None), errors.append(str(e)[-2000:])
            yield frame.assign(reply=replies, error=errors)[["doc_id", "reply", "error"]]

    kind = prompts.schema["doc_id"].dataType.simpleString()
    return prompts.select(*columns).mapInPandas(run, f"doc_id {kind}, reply string, error string")


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 64, delays=EMBED_DELAYS) -> DataFrame:
    """rows (vec_id, text) -> vec_id, embedding, in batches of texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(model, delays)
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame({"vec_id": part.vec_id, "embedding": call(part.text.tolist())})

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "text").mapInPandas(run, f"vec_id {kind}, embedding array<double>")
