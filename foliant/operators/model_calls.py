"""Calls of language models over rows: a client protocol, a scripted client, retries on answers that don't fit, and jobs on top.

No client for a real service ships here; anything with complete(messages) will do. The client is made once per
worker by a factory that Spark sends there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> str: ...


@dataclass
class ScriptedClient:
    """Answers by the first mark that the last message holds; lists of answers are given one after the other."""

    answers: dict[str, str | list[str]]
    default: str = "{}"
    calls: list[str] = field(default_factory=list)

    def complete(self, messages: list[dict[str, str]]) -> str:
        asked = messages[-1]["content"]
        self.calls.append(asked)
        everything = "\n".join(m["content"] for m in messages)
        for mark, answer in self.answers.items():
            if mark in everything:
                if isinstance(answer, str):
                    return answer
                return answer.pop(0) if len(answer) > 1 else answer[0]
        return self.default


@dataclass(frozen=True)
class Attempt:
    number: int
    ok: bool
    answer: str
    error: str | None


def extract_json(client: ModelClient, messages: list[dict[str, str]], check: Callable[[dict], str | None] = lambda x: None, retries: int = 2) -> tuple[dict | None, list[Attempt]]:
    """The first answer that is a JSON object and passes ``check`` (None: fine, else what is wrong), and all attempts.

    After an answer that doesn't fit, the model is told why.
    """
    talk, attempts = list(messages), []
    for number in range(1, retries + 2):
        answer = client.complete(talk)
        try:
            found = json.loads(answer)
            error = "not an object" if not isinstance(found, dict) else check(found)
        except json.JSONDecodeError as e:
            found, error = None, f"not JSON: {e.msg}"
        attempts.append(Attempt(number, error is None, answer, error))
        if error is None:
            return found, attempts
        talk += [{"role": "assistant", "content": answer}, {"role": "user", "content": f"The answer was rejected: {error}. Answer again with one JSON object."}]
    return None, attempts


def call(df: DataFrame, prompt: str, client: Callable[[], ModelClient], key: str, system: str = "", check: Callable[[dict], str | None] = lambda x: None, retries: int = 2) -> DataFrame:
    """(key, answer, attempts, error): one call for each row's prompt; a row that fails has an error, and the job goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        for rows in batches:
            out = []
            for k, text in zip(rows[key], rows["prompt"], strict=True):
                messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text or ""}]
                try:
                    found, attempts = extract_json(made, messages, check, retries)
                    error = None if found is not None else attempts[-1].error
                except Exception as e:  # the client's own failures are the row's, not the job's
                    found, attempts, error = None, [], f"{type(e).__name__}: {e}"
                out.append((k, None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True), len(attempts), error))
            yield pd.DataFrame(out, columns=["key", "answer", "attempts", "error"])

    rows = df.select(key, F.col(prompt).alias("prompt"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, answer string, attempts int, error string").withColumnRenamed("key", key)


def items(answers: DataFrame, name: str, schema: str, key: str = "doc_id") -> DataFrame:
    """(key, ord, ...): the answers' lists called ``name``, a row per item."""
    parsed = F.from_json("answer", f"struct<{name}:array<struct<{schema}>>>")
    return answers.select(key, F.posexplode(parsed[name]).alias("ord", "item")).select(key, "ord", "item.*")


def map_reduce(df: DataFrame, text: str, client: Callable[[], ModelClient], key: str = "doc_id", window: int = 20_000) -> DataFrame:
    """(key, answer): one call for a text that fits a window; else one for each window and one that merges their answers."""
    from foliant.operators.chunking import break_windows

    parts = break_windows(df, window, key, text)
    sized = parts.join(parts.groupBy(F.col(key).alias("k2")).agg(F.count(F.lit(1)).alias("n")), F.col(key) == F.col("k2")).drop("k2")
    asked = sized.withColumn("call_id", F.concat_ws(":", F.col(key).cast("string"), F.col("chunk").cast("string"))).withColumn("prompt", F.concat(F.when(F.col("n") == 1, F.lit("SINGLE\n")).otherwise(F.lit("PART\n")), "text"))
    got = asked.join(call(asked, "prompt", client, "call_id").where("answer is not null"), "call_id")
    one = got.where("n = 1").select(key, "answer")
    partial = got.where("n > 1").groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "answer"))), lambda x: x["answer"])).alias("all"))
    merged = call(partial.withColumn("prompt", F.concat(F.lit("MERGE\n"), "all")), "prompt", client, key).where("answer is not null").select(key, "answer")
    return one.unionByName(merged)


def section_prompt(section, text, most: int = 12_000):
    """A section's text, cut to ``most`` characters, under its title."""
    return F.concat(F.lit("Section: "), section, F.lit("\n\n"), F.left(text, F.lit(most)))
