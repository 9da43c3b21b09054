"""Model calls behind one interface, with a deterministic offline default. A provider works on a batch of prompts."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

Complete = Callable[[list[str]], list[str]]
REFUSAL = "Xin lỗi, không có đủ thông tin để trả lời."


def overlap_points(prompt: str, limit: int = 5) -> str:
    """Offline answer to a map prompt 'question\\n---\\ncontext': its lines scored 0 to 100 by words shared with the question."""
    question, _, context = prompt.partition("\n---\n")
    asked = set(re.findall(r"\w+", question.lower()))
    points = []
    for line in context.split("\n"):
        words = set(re.findall(r"\w+", line.lower()))
        if words and asked:
            points.append({"description": line.strip(), "score": round(100 * len(words & asked) / len(asked))})
    points.sort(key=lambda p: (-p["score"], p["description"]))
    return json.dumps({"points": points[:limit]}, ensure_ascii=False)


def hashed_vector(text: str, dims: int = 64) -> list[float]:
    """Offline embedding: hashed bag of words, unit length."""
    v = [0.0] * dims
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1 if h >> 63 else -1
    n = sum(x * x for x in v) ** 0.5 or 1.0
    return [x / n for x in v]


def joined_descriptions(prompt: str) -> str:
    """Offline consolidation: the different lines, sorted."""
    return "; ".join(sorted({x.strip() for x in prompt.split("\n") if x.strip()}))


@dataclass
class Offline:
    """Answers each prompt by a function; the default for every model-backed step."""

    answer: Callable[[str], str] = overlap_points

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


@dataclass
class Keyed:
    """One provider under several keys, which take turns; a call that fails is tried again under the next key.

    wait: seconds before each further try, the last for all that follow."""

    call: Callable[[str, list[str]], list[str]]
    keys: list[str]
    tries: int = 3
    wait: tuple[float, ...] = (0.0, 1.0, 5.0)
    turn: int = 0

    def __call__(self, prompts: list[str]) -> list[str]:
        if not self.keys:
            raise RuntimeError("no key")
        for k in range(self.tries):
            key, self.turn = self.keys[self.turn % len(self.keys)], self.turn + 1
            try:
                return self.call(key, prompts)
            except Exception:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait[min(k, len(self.wait) - 1)])
        raise RuntimeError("no tries")


@dataclass
class Routed:
    """Tries providers in order; one that fails is left out for as many batches as it has failed so far."""

    providers: list[Complete]
    failed: dict[int, int] = field(default_factory=dict)
    locked: dict[int, int] = field(default_factory=dict)

    def __call__(self, prompts: list[str]) -> list[str]:
        error: Exception | None = None
        for i, p in enumerate(self.providers):
            if self.locked.get(i, 0) > 0:
                self.locked[i] -= 1
                continue
            try:
                return p(prompts)
            except Exception as e:
                error = e
                self.failed[i] = self.failed.get(i, 0) + 1
                self.locked[i] = self.failed[i]
        raise error or RuntimeError("every provider is locked")


def complete(df: DataFrame, prompt: str, output: str, provider: Complete, batch: int = 6, calls: int | None = None, error: str | None = None) -> DataFrame:
    """df with the provider's answers; a failed batch gives nulls. calls: partitions that call at the same time; error: a
    column for what went wrong with a row's batch, so that what is missing can be counted and asked again."""
    schema = StructType([*df.schema.fields, StructField(output, StringType()), *([StructField(error, StringType())] if error else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for i in range(0, len(g), batch):
                some = g[prompt].iloc[i : i + batch].tolist()
                try:
                    answers += provider(some)
                    errors += [None] * len(some)
                except Exception as e:
                    answers += [None] * len(some)
                    errors += [f"{type(e).__name__}: {e}"] * len(some)
            yield g.assign(**{output: answers}, **({error: errors} if error else {}))

    return (df.repartition(calls) if calls else df).mapInPandas(run, schema)
