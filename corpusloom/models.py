"""Interfaces of external models, with deterministic stand-ins.

The stand-ins keep the pipeline runnable without a model. Their vectors and answers mean nothing
and are no substitute for a model's.
"""

from __future__ import annotations

import hashlib
import importlib
import time
from collections.abc import Callable, Iterator
from json import dumps
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Generator(Protocol):
    def __call__(self, prompt: str, system: str, temperature: float, json: bool = False) -> str | tuple[str | None, str | None]: ...


def is_ready(model, *probe) -> bool:
    """Whether a model says that it answers; one that has no ``ready`` is asked the probe."""
    try:
        return bool(model.ready()) if hasattr(model, "ready") else model(*probe) is not None
    except Exception:
        return False


class HashEmbedder:
    """Stand-in: a unit vector of hashed words."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.size] += 1 if h & 0x10000 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class EchoGenerator:
    """Stand-in: says how long the prompt is; asked for JSON, it names the prompt by its hash."""

    def __call__(self, prompt: str, system: str = "", temperature: float = 0.3, json: bool = False) -> str:
        if json:
            name = hashlib.md5(prompt.encode("utf-8", "replace")).hexdigest()
            return dumps({"question": f"What does text {name} say?", "answer": f"Text {name} has {len(prompt)} characters."})
        return f"<think>stand-in</think>A prompt of {len(prompt)} characters."

    def ready(self) -> bool:
        return True


def embed(df: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 32) -> DataFrame:
    """(key, embedding, status): texts in batches, one by one where a batch fails, null where one does.

    ``status`` is ok or failed; rows with a null text are failed. The order of rows is kept.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for begin in range(0, len(f), batch):
                part = f.iloc[begin : begin + batch]
                texts = part[text].tolist()
                try:
                    if any(t is None for t in texts):
                        raise ValueError("a null text")
                    vectors = list(embedder(texts))
                except Exception:
                    vectors = []
                    for t in texts:
                        try:
                            vectors.append(None if t is None else embedder([t])[0])
                        except Exception:
                            vectors.append(None)
                yield pd.DataFrame({key: part[key], "embedding": vectors, "status": ["ok" if v is not None else "failed" for v in vectors]})

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>, status string")


def answer_of(reply: str | tuple[str | None, str | None] | None) -> str | None:
    """The text of a reply; of an (answer, thinking) pair the answer, or the thinking where it is blank."""
    if isinstance(reply, tuple):
        answer, thinking = ((x or "").strip() for x in reply)
        return answer or thinking
    return reply


def generate(
    df: DataFrame,
    key: str,
    prompt: str,
    generator: Generator,
    system: str = "",
    temperature: float = 0.3,
    retries: int = 2,
    wait: float = 2.0,
    keep: list[str] | None = None,
    json: bool = False,
    traced: bool = False,
) -> DataFrame:
    """(key, kept columns, raw): a generated text for each prompt, null when all tries fail.

    ``json`` asks the generator for JSON only. A generator may give an (answer, thinking) pair,
    see :func:`answer_of`. ``traced`` adds ``error`` (null, ``timeout`` or ``failed``, of the last
    try) and ``seconds`` (of all tries).
    """
    kept = [key, *(keep or [])]
    schema = df.select(*kept).schema.add("raw", "string")
    if traced:
        schema = schema.add("error", "string").add("seconds", "double")
    extra = {"json": True} if json else {}

    def once(p: str | None) -> tuple[str | None, str | None, float]:
        began, error = time.time(), None
        for attempt in range(retries + 1 if p is not None else 0):
            try:
                return answer_of(generator(p, system, temperature, **extra)), None, time.time() - began
            except Exception as e:
                error = "timeout" if isinstance(e, TimeoutError) or "timeout" in type(e).__name__.lower() else "failed"
                if attempt < retries:
                    time.sleep(wait)
        return None, error, time.time() - began

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [once(p) for p in f[prompt]]
            out = f[kept].assign(raw=[m[0] for m in made])
            yield out.assign(error=[m[1] for m in made], seconds=[m[2] for m in made]) if traced else out

    return df.select(*dict.fromkeys([*kept, prompt])).mapInPandas(run, schema)


def render_documents(files: DataFrame, renderer: Callable[[bytes], str]) -> DataFrame:
    """(path, text) of binary files by a renderer; null where it fails or a file has no content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for content in f["content"]:
                try:
                    texts.append(renderer(bytes(content)))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({"path": f["path"], "text": texts})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


class Tokenizer(Protocol):
    """A subword tokenizer for chunking; windows are measured in its tokens."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


def load(name: str):
    """The object ``package.module:name`` stands for, for models named on a command line."""
    module, _, member = name.partition(":")
    return getattr(importlib.import_module(module), member)


def failed_out(embedded: DataFrame) -> DataFrame:
    return embedded.where(F.col("embedding").isNotNull()).drop("status")
