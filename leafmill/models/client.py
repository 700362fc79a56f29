"""Models behind a small protocol. Columns that call one run as iterator Pandas UDFs: one client for each worker, many rows to a batch."""

from __future__ import annotations

import base64
import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Client = Callable[[list[dict]], dict]


@dataclass(frozen=True)
class HttpChat:
    """A chat endpoint: temperature 0, JSON in and out."""

    url: str
    model: str
    key: str = ""
    max_tokens: int = 1024
    timeout: float = 600.0

    def __call__(self, messages: list[dict]) -> dict:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": 0, "max_tokens": self.max_tokens}).encode()
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", body, head), timeout=self.timeout) as reply:
            got = json.load(reply)
        return {"text": got["choices"][0]["message"]["content"], "usage": got.get("usage") or {}}


@dataclass(frozen=True)
class StandIn:
    """Answers that depend on the request alone, for tests and for runs without a model."""

    answer: str = "text"

    def __call__(self, messages: list[dict]) -> dict:
        return {"text": self.answer, "usage": {"completion_tokens": len(self.answer.split())}}


def text_message(text: str) -> list[dict]:
    return [{"role": "user", "content": text}]


def image_message(prompt: str, image: bytes, mime: str = "image/png") -> list[dict]:
    url = f"data:{mime};base64,{base64.b64encode(image).decode()}"
    return [{"role": "user", "content": [{"type": "text", "text": prompt}, {"type": "image_url", "image_url": {"url": url}}]}]


def chat(client: Client, prompt: str = "", tries: int = 2) -> Callable[[Column], Column]:
    """A column function: text, latency_ms, tokens and error of the model's answer to each text or image. A call that fails is tried again once; then text is null."""

    @F.pandas_udf("text string, latency_ms long, tokens long, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch:
                row, began = (None, 0, None, None), time.monotonic()
                for _ in range(tries if x is not None else 0):
                    try:
                        got = client(image_message(prompt, x) if isinstance(x, bytes | bytearray) else text_message(prompt + x))
                        usage = got.get("usage") or {}
                        row = (got["text"].strip(), int(1000 * (time.monotonic() - began)), usage.get("completion_tokens", usage.get("generated_tokens")), None)
                        break
                    except Exception as e:
                        row = (None, int(1000 * (time.monotonic() - began)), None, str(e))
                out.append(row)
            frame = pd.DataFrame(out, columns=["text", "latency_ms", "tokens", "error"])
            yield frame.astype({"latency_ms": "int64", "tokens": "Int64"})

    return call


def answer(client: Client, prompt: str = "") -> Callable[[Column], Column]:
    """The text alone."""
    return lambda c: chat(client, prompt)(c)["text"]


def embedding(client: Callable[[list[str]], list[dict]] | None = None, width: int = 16) -> Callable[[Column], Column]:
    """A column function: unit vectors of texts, a batch of texts to a call; replies are put in order by their index. Without a client hashed words stand in."""

    def hashed(texts: list[str]) -> list[dict]:
        out = []
        for i, t in enumerate(texts):
            vector = [0.0] * width
            for w in t.lower().split():
                vector[hashlib.md5(w.encode()).digest()[0] % width] += 1.0
            out.append({"index": i, "embedding": vector})
        return out

    ask = client or hashed

    @F.pandas_udf("array<float>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = [np.asarray(r["embedding"], np.float32) for r in sorted(ask([x or "" for x in batch]), key=lambda r: r["index"])]
            yield pd.Series([(v / n if (n := np.linalg.norm(v)) else v).tolist() for v in found])

    return call
