"""Text generation behind a small interface, called once per Arrow batch inside tasks."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Provider(Protocol):
    def generate(self, prompt: str) -> str: ...


class MockProvider:
    """Canned answers: the first keyword in the prompt decides, else the digest of the prompt picks one."""

    def __init__(self, answers: list[str] | None = None, by_keyword: dict[str, str] | None = None):
        self.answers, self.by_keyword = answers or [""], by_keyword or {}

    def generate(self, prompt: str) -> str:
        for word, answer in self.by_keyword.items():
            if word in prompt:
                return answer
        return self.answers[zlib.crc32(prompt.encode("utf-8", "surrogatepass")) % len(self.answers)]


class RuleProvider:
    """Answers by a function of the prompt."""

    def __init__(self, rule: Callable[[str], str]):
        self.rule = rule

    def generate(self, prompt: str) -> str:
        return self.rule(prompt)


PROVIDERS: dict[str, Callable[..., Provider]] = {"mock": MockProvider, "rule": RuleProvider}


def register(name: str, factory: Callable[..., Provider]) -> None:
    PROVIDERS[name] = factory


def provider(name: str, **options) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](**options)


def check_options(temperature: float = 0.7, top_p: float = 1.0, max_tokens: int = 1024) -> None:
    if not 0 <= temperature <= 2 or not 0 <= top_p <= 1 or max_tokens <= 0:
        raise ValueError("temperature is from 0 to 2, top_p from 0 to 1 and max_tokens positive")


def generate(df: DataFrame, prompt: str, make: Callable[[], Provider], attempts: int = 3) -> DataFrame:
    """``df`` with ``answer``, ``error`` and ``duration_ms`` of each prompt.

    Every task makes one provider and tries a prompt up to ``attempts`` times; a
    failure is a value, so one bad row does not end the job.  A null prompt has a
    null answer.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("answer", T.StringType()), T.StructField("error", T.StringType()), T.StructField("duration_ms", T.LongType())])

    def run(batches):
        import pyarrow as pa

        client = make()
        for batch in batches:
            answers, errors, took = [], [], []
            for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                began, answer, error = time.monotonic(), None, None
                for _ in range(attempts if text is not None else 0):
                    try:
                        answer, error = client.generate(text), None
                        break
                    except Exception as e:  # noqa: BLE001 a provider may fail in any way
                        error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                errors.append(error)
                took.append(int((time.monotonic() - began) * 1000))
            columns = [*batch.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string()), pa.array(took, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)
