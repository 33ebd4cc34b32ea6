"""Language models behind the engine: an interface, a client for hosted ones, and a deterministic stand-in for tests."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Model(Protocol):
    def embed(self, text: str) -> list[float]: ...

    def embed_many(self, texts: list[str]) -> list[list[float]]: ...

    def chat(self, messages: list[dict[str, str]]) -> str: ...

    def chat_stream(self, messages: list[dict[str, str]]) -> Iterator[str]: ...


class HashModel:
    """Unit vectors from token hashes. No chat."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.width
        for token in text.lower().split():
            d = hashlib.blake2b(token.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "big") % self.width] += 1 if d[4] & 1 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        return [x / norm for x in v]

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def chat(self, messages: list[dict[str, str]]) -> str:
        raise NotImplementedError("local chat is not yet implemented")

    def chat_stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        return iter([self.chat(messages)])


class HostedModel:
    """A service with the endpoints /embeddings and /responses."""

    def __init__(self, base_url: str, api_key: str, chat_model: str, embed_model: str, timeout: float = 60.0):
        self.base_url, self.api_key, self.chat_model, self.embed_model, self.timeout = base_url.rstrip("/"), api_key, chat_model, embed_model, timeout

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)

    def embed(self, text: str) -> list[float]:
        data = self._post("/embeddings", {"model": self.embed_model, "input": text}).get("data") or [{}]
        return data[0].get("embedding", [])

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        """Embeddings of some texts by one request."""
        data = self._post("/embeddings", {"model": self.embed_model, "input": texts}).get("data") or []
        found = {d.get("index", i): d.get("embedding", []) for i, d in enumerate(data)}
        return [found.get(i, []) for i in range(len(texts))]

    def request(self, messages: list[dict[str, str]], previous: str | None) -> dict:
        """Body of a response call: a leading system message as instructions; after a previous response, the last user message alone."""
        system = messages[0]["content"] if messages and messages[0]["role"] == "system" else None
        turns = messages[1:] if system is not None else messages
        body: dict = {"model": self.chat_model, "store": previous is not None}
        if system is not None:
            body["instructions"] = system
        if previous is None:
            body["input"] = turns
        else:
            body |= {"previous_response_id": previous, "input": turns[-1]["content"] if turns and turns[-1]["role"] == "user" else ""}
        return body

    def respond(self, messages: list[dict[str, str]], previous: str | None = None) -> tuple[str, str]:
        """Text and id of the answer."""
        got = self._post("/responses", self.request(messages, previous))
        parts = [c.get("text", "") for o in got.get("output", []) if o.get("type") == "message" for c in o.get("content", []) if c.get("type") == "output_text"]
        return (parts[0] if parts else ""), got.get("id", "")

    def chat(self, messages: list[dict[str, str]]) -> str:
        return self.respond(messages)[0]

    def chat_stream(self, messages: list[dict[str, str]]) -> Iterator[str]:
        """The whole answer as one part; the service is not asked to stream."""
        return iter([self.chat(messages)])


#: Texts of one request.
TOGETHER = 64


def embedding_column(model: Model, text: Column) -> Column:
    """Embeddings of a text column, some texts a request; a text whose embedding fails gets null.

    The texts of a request that fails are asked for one by one, so that one bad text costs no other's vector.
    """

    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return [float(x) for x in model.embed(t)] or None
            except Exception as e:  # the chunk is kept without a vector
                print(f"embed warning: {e}")
                return None

        def together(some):
            try:
                return [[float(x) for x in v] or None for v in model.embed_many(some)]
            except Exception as e:
                print(f"embed warning: {e}")
                return [one(t) for t in some]

        every = texts.tolist()
        return pd.Series([v for i in range(0, len(every), TOGETHER) for v in together(every[i : i + TOGETHER])], dtype=object)

    return F.pandas_udf(run, "array<float>")(text)
