"""Model providers: interfaces that run in Arrow batches, with deterministic stand-ins.

A provider is a picklable object; its model is loaded once per Python worker in ``load``. A failing row gives a null and a message, never zeros.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import text


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts with rising temperature and exponential waits."""

    attempts: int = 3
    temperature: float = 0.01
    step: float = 0.05
    base: float = 2.0

    def temperature_at(self, attempt: int) -> float:
        return min(self.temperature + self.step * attempt, 2 * self.temperature) if attempt else self.temperature

    def wait_at(self, attempt: int) -> float:
        return self.base**attempt

    def run(self, call: Callable[[float], Any], sleep: Callable[[float], None] = time.sleep) -> Any:
        """The first result that is not None; raises the last error, or LookupError if there was none."""
        problem: Exception = LookupError("the model gave nothing")
        for attempt in range(self.attempts):
            try:
                if (out := call(self.temperature_at(attempt))) is not None:
                    return out
            except Exception as e:  # noqa: BLE001
                problem = e
            if attempt + 1 < self.attempts:
                sleep(self.wait_at(attempt))
        raise problem


class Model(Protocol):
    """What a provider calls: a row's input to its output."""

    def load(self) -> Callable[[str], Any]: ...


class BatchModel(Protocol):
    """A provider that takes ``batch`` inputs at once."""

    batch: int

    def load_batch(self) -> Callable[[list], list]: ...


def _in_batches(call: Callable[[list], list], size: int, values: list) -> Iterator[tuple[Any, str | None]]:
    """(output, message) of every input; a batch that fails is tried one by one, so that only bad inputs have no output."""
    for lo in range(0, len(values), size):
        part = values[lo : lo + size]
        have = [x for x in part if x is not None]
        try:
            done = iter(call(have) if have else [])
            yield from [(None, None) if x is None else (next(done), None) for x in part]
        except Exception:  # noqa: BLE001
            for x in part:
                try:
                    yield (None if x is None else call([x])[0], None)
                except Exception as e:  # noqa: BLE001
                    yield None, f"{type(e).__name__}: {e}"[:500]


def mapped(df: DataFrame, model: Model | BatchModel, column: str, output: str, kind: str, encode: Callable[[Any], Any] = lambda x: x) -> DataFrame:
    """``df`` with ``output`` from the model and ``<output>_error``, in Arrow batches."""
    schema = df.select("*", F.lit(None).cast(kind).alias(output), F.lit(None).cast("string").alias(f"{output}_error")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        many = model.load_batch() if hasattr(model, "load_batch") else None
        call = None if many else model.load()
        for batch in batches:
            good, bad = [], []
            if many:
                for y, problem in _in_batches(many, model.batch, batch[column].tolist()):
                    good.append(None if y is None else encode(y))
                    bad.append(problem)
                yield batch.assign(**{output: pd.Series(good, index=batch.index, dtype=object), f"{output}_error": pd.Series(bad, index=batch.index, dtype=object)})
                continue
            for x in batch[column]:
                try:
                    good.append(None if x is None else encode(call(x)))
                    bad.append(None)
                except Exception as e:  # noqa: BLE001
                    good.append(None)
                    bad.append(f"{type(e).__name__}: {e}"[:500])
            yield batch.assign(**{output: pd.Series(good, index=batch.index, dtype=object), f"{output}_error": pd.Series(bad, index=batch.index, dtype=object)})

    return df.mapInPandas(run, schema)


@dataclass(frozen=True)
class HashEmbedder:
    """A stand-in for an embedding model: signed hashes of words, normalised. ``model`` decides on the query prefix."""

    dimension: int = 64
    model: str = "stub-bge"
    batch: int = 32

    def load_batch(self) -> Callable[[list[str]], list[list[float]]]:
        one = self.load()
        return lambda texts: [one(t) for t in texts]

    def load(self) -> Callable[[str], list[float]]:
        def embed(content: str) -> list[float]:
            v = np.zeros(self.dimension)
            for w in re.findall(r"\w+", content.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return embed

    def documents(self, df: DataFrame, content: str = "content") -> DataFrame:
        """Adds ``embedding``."""
        return mapped(df, self, content, "embedding", "array<float>").drop("embedding_error")

    def queries(self, df: DataFrame, content: str = "content") -> DataFrame:
        """Adds ``embedding`` of the prefixed text."""
        asked = df.withColumn("_q", text.query_prefix(F.col(content), self.model))
        return mapped(asked, self, "_q", "embedding", "array<float>").drop("embedding_error", "_q")


@dataclass(frozen=True)
class EchoModel:
    """A stand-in for a generator: the prompt's first passage up to a length, and log-probabilities from a hash of the prompt."""

    length: int = 120
    tops: int = 5

    def load(self) -> Callable[[str], dict]:
        def generate(prompt: str) -> dict:
            m = re.search(r"\[Document 1\]\n(.*?)(?:\n\n|\Z)", prompt, re.S)
            answer = (m[1] if m else "")[: self.length]
            seed = int.from_bytes(hashlib.blake2b(prompt.encode(), digest_size=4).digest(), "little")
            rng = np.random.default_rng(seed)
            probs = [np.sort(rng.dirichlet(np.full(self.tops, 0.5)))[::-1] for _ in range(3)]
            return {"answer": answer + " [Document 1]" if answer else "", "logprobs": [[float(np.log(max(p, 1e-12))) for p in row] for row in probs], "prompt_tokens": len(prompt) // 4, "completion_tokens": len(answer) // 4}

        return generate


ANSWER = "struct<answer:string,logprobs:array<array<double>>,prompt_tokens:int,completion_tokens:int>"


def generated(prompts: DataFrame, model: Model = EchoModel()) -> DataFrame:
    """``prompts`` (with ``prompt``) and the columns of the answer."""
    out = mapped(prompts, model, "prompt", "generation", ANSWER)
    return out.select(*prompts.columns, "generation.*", "generation_error")


def _post(url: str, body: bytes, kind: str, token: str | None, timeout: float) -> bytes:
    request = urllib.request.Request(url, body, {"Content-Type": kind} | ({"Authorization": f"Bearer {token}"} if token else {}))
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return reply.read()


@dataclass(frozen=True)
class ChatEndpoint:
    """A generator behind an HTTP endpoint of the common chat-completions form, with log-probabilities of the likeliest tokens.

    A prompt is a string, sent as the user's message after the system's. ``generation`` of a row that fails is null with a message.
    """

    url: str
    model: str
    system: str = text.SYSTEM_PROMPT
    max_tokens: int = 512
    temperature: float = 0.1
    top_p: float = 0.9
    top_logprobs: int = 20
    token: str | None = None
    timeout: float = 120.0
    policy: RetryPolicy = RetryPolicy()

    def load(self) -> Callable[[str], dict]:
        def ask(prompt: str, temperature: float) -> dict:
            messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
            body = {"model": self.model, "messages": messages, "max_tokens": self.max_tokens, "temperature": temperature, "top_p": self.top_p, "logprobs": True, "top_logprobs": self.top_logprobs}
            data = json.loads(_post(self.url, json.dumps(body).encode(), "application/json", self.token, self.timeout))
            choice, usage = data["choices"][0], data.get("usage") or {}
            tops = [{t["token"]: float(t["logprob"]) for t in x.get("top_logprobs") or []} for x in ((choice.get("logprobs") or {}).get("content") or [])]  # a repeated token counts once, the last time
            return {"answer": choice["message"]["content"], "logprobs": [list(t.values()) for t in tops if t], "prompt_tokens": usage.get("prompt_tokens"), "completion_tokens": usage.get("completion_tokens")}

        return lambda prompt: self.policy.run(lambda more: ask(prompt, max(self.temperature, more)))

    def reachable(self) -> bool:
        """Whether the endpoint answers at all."""
        try:
            self.load()("Say yes.")
        except Exception:  # noqa: BLE001
            return False
        return True


@dataclass(frozen=True)
class LayoutEndpoint:
    """A layout model behind an HTTP endpoint: a page's bytes are posted, the reply is JSON with ``elements`` or ``layout``."""

    url: str
    kind: str = "application/octet-stream"
    token: str | None = None
    timeout: float = 120.0

    def load(self) -> Callable[[bytes], str]:
        read = LayoutReader().load()
        return lambda page: read(_post(self.url, page if isinstance(page, bytes) else str(page).encode(), self.kind, self.token, self.timeout).decode())


@dataclass(frozen=True)
class BlockDetector:
    """A stand-in for a layout model that sees text blocks instead of an image: ``[{"text", "ymin", "xmin", "ymax", "xmax"}]`` to a reply with elements.

    Lines in capitals are headers, runs of lines with bars tables, lines that begin like a caption captions, other runs text.
    """

    def load(self) -> Callable[[str], str]:
        def kind(line: str) -> str:
            s = line.strip()
            if s.isupper() and len(s) > 5:
                return "HEADER"
            if s.count("|") >= 2:
                return "TABLE"
            return "CAPTION" if s.lower().startswith(text.CAPTION_WORDS) else "TEXT"

        def detect(blocks: str) -> str:
            out: list[dict] = []
            for b in json.loads(blocks):
                k = kind(b["text"])
                if out and out[-1]["type"] == k and k in ("TABLE", "TEXT"):
                    last = out[-1]["box"]
                    out[-1]["box"] = [min(last[0], b["ymin"]), min(last[1], b["xmin"]), max(last[2], b["ymax"]), max(last[3], b["xmax"])]
                else:
                    out.append({"type": k, "box": [b["ymin"], b["xmin"], b["ymax"], b["xmax"]]})
            return json.dumps({"elements": out})

        return detect


@dataclass(frozen=True)
class TableReader:
    """A stand-in for a vision model: gives the text it is handed, after the retry policy."""

    policy: RetryPolicy = RetryPolicy()

    def load(self) -> Callable[[str], str]:
        return lambda content: self.policy.run(lambda _t: content or None, sleep=lambda _s: None)


@dataclass(frozen=True)
class LayoutReader:
    """A stand-in for a layout model: the elements of a JSON reply under ``elements`` or ``layout``; anything else is an empty page."""

    def load(self) -> Callable[[str], str]:
        def read(reply: str) -> str:
            try:
                data = json.loads(reply)
            except ValueError:
                data = {}
            return json.dumps(data.get("elements", data.get("layout", [])) if isinstance(data, dict) else data)

        return read


class PageSource(Protocol):
    """Turns a file's bytes into pages: (page number, text blocks)."""

    def pages(self, content: bytes) -> Iterator[tuple[int, list[tuple[str, float, float, float, float]]]]: ...


@dataclass(frozen=True)
class PlainPages:
    """A page source for text files: pages at form feeds, a block per line, boxes from line numbers."""

    line_height: float = 20.0

    def pages(self, content: bytes) -> Iterator[tuple[int, list[tuple[str, float, float, float, float]]]]:
        for n, page in enumerate(content.decode("utf-8").split("\f"), 1):
            yield n, [(t, 0.0, i * self.line_height, 8.0 * len(t), (i + 1) * self.line_height) for i, t in enumerate(page.split("\n")) if t.strip()]


def read_pages(files: DataFrame, source: PageSource = PlainPages()) -> DataFrame:
    """``path, page, line, text, x1, y1, x2, y2, problem`` of files read by ``binaryFile``; a bad file or page gives a row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    for page, blocks in source.pages(content):
                        out += [(path, page, i, *b, None) for i, b in enumerate(blocks)]
                except Exception as e:  # noqa: BLE001
                    out.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "page", "line", "text", "x1", "y1", "x2", "y2", "problem"]).astype({"page": "Int32", "line": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, line int, text string, x1 double, y1 double, x2 double, y2 double, problem string")
