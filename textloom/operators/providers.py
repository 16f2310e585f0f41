"""What calls an outside service (embedders, classifiers, writers): its shape, retries, and stand-ins without a network."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.materialize import Workspace


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Classifier(Protocol):
    def __call__(self, texts: list[str]) -> list[int]: ...


class Writer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashedWords:
    """An embedder without a model: signed hashes of words, in length one."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.sqrt((out * out).sum(1))[:, None]
        return (out / np.where(n > 0, n, 1)).tolist()


class Rule:
    """A classifier without a model: the first rule that says yes, else 0."""

    def __init__(self, *rules: Callable[[str], bool]) -> None:
        self.rules = rules

    def __call__(self, texts: list[str]) -> list[int]:
        return [next((i + 1 for i, r in enumerate(self.rules) if r(t)), 0) for t in texts]


class Echo:
    """A writer without a model: the first words of the prompt."""

    def __init__(self, words: int = 20) -> None:
        self.words = words

    def __call__(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.split()[: self.words]) for p in prompts]


def retried(call: Callable[[list[str]], list], tries: int = 3, wait: float = 1.0) -> Callable[[list[str]], list]:
    """The call with some tries, doubling the wait, that has to answer every text once."""

    def again(texts: list[str]) -> list:
        for attempt in range(tries):
            try:
                got = call(texts)
                if len(got) != len(texts):
                    raise ValueError(f"{len(got)} answers to {len(texts)} texts")
                return got
            except Exception:
                if attempt + 1 == tries:
                    raise
                time.sleep(wait * 2**attempt)
        return []

    return again


def called(df: DataFrame, key: str, text: str, call: Callable[[list[str]], list], out: str, kind: str, batch: int = 64) -> DataFrame:
    """``key`` and ``out``: the answers to every text, ``batch`` texts a call; a null text has a null answer."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers: list = [None] * len(frame)
            asked = [i for i, t in enumerate(frame["_t"]) if isinstance(t, str)]
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                for i, a in zip(part, call([frame["_t"].iloc[i] for i in part]), strict=True):
                    answers[i] = a
            yield pd.DataFrame({key: frame[key], out: answers})

    rows = df.select(key, F.col(text).alias("_t"))
    return rows.mapInPandas(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, `{out}` {kind}")


#: Of how many queries that a writer is asked for which one is kept, by kind of prompt: of five from vague to specific the fourth.
CHOICES = {"single": (1, 0), "ordered": (5, 3)}


def chosen_query(answers: DataFrame, key: str, answer: str, choice: str = "single") -> DataFrame:
    """``key, query``: of an answer, a JSON array of as many different strings as asked for, the one kept; null for any other answer."""
    wanted, place = CHOICES[choice]
    return answers.select(key, F.element_at(T.parsed_items(F.col(answer), wanted), place + 1).alias("query"))


def generated(df: DataFrame, key: str, text: str, write: Callable[[list[str]], list[str | None]], problem: Callable[[DataFrame], DataFrame], prompt: str, tries: int = 3) -> DataFrame:
    """``key, query, tries, problem``: queries written for texts, those with a problem written again with it told.

    ``write`` answers prompts, null meaning that there is nothing to write.
    ``problem`` takes ``key, text, query`` and gives ``key, problem``, null where there is none. After ``tries`` rounds
    what still has a problem has a null query and its last problem. Each round
    asks for the rejected texts only; its answers are written, so that no
    answer is asked for twice. Null texts have no query and are never asked for.
    """
    workspace = Workspace(df.sparkSession, "generated")
    todo = df.select(key, F.col(text).alias("text"), F.lit("").alias("told")).where("text is not null")
    done = []
    for attempt in range(1, tries + 1):
        asked = todo.select(key, F.concat(F.lit(prompt + "\n\n"), "text", "told").alias("prompt"))
        answers = called(asked, key, "prompt", write, "query", "string")
        held = workspace.cut(todo.drop("told").join(answers, key))
        judged = problem(held.where("query is not null")).select(key, "problem")
        both = workspace.cut(held.join(judged, key, "left"))
        last = attempt == tries
        final = both if last else both.where("problem is null")
        done.append(final.select(key, F.when(F.col("problem").isNull(), F.col("query")).alias("query"), F.lit(attempt).alias("tries"), "problem"))
        told = F.concat(F.lit("\n\nNot accepted: "), "query", F.lit("\nBecause: "), "problem", F.lit("\nWrite another one."))
        todo = both.where("problem is not null").select(key, "text", told.alias("told"))
        if last or todo.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)
