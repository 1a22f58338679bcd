"""The boundary to text generators: a protocol, a stand-in that needs no network, and the operator that runs one over rows."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.asking import told


class Completer(Protocol):
    """Anything that answers a prompt."""

    def complete(self, system: str, user: str) -> str: ...


@dataclass
class Stub:
    """Answers with the first sentences of what it is asked, so results are the same everywhere."""

    sentences: int = 2

    def complete(self, system: str, user: str) -> str:
        return " ".join(re.split(r"(?<=[.!?])\s+", user.strip())[: self.sentences])


@dataclass
class Retry:
    """Asks again after a failure, waiting twice as long each time; a cache of bounded size answers repeated prompts."""

    inner: Completer
    attempts: int = 5
    delay: float = 2.0
    most: int = 1024
    known: dict[tuple[str, str], str] = field(default_factory=dict)

    def complete(self, system: str, user: str) -> str:
        if (system, user) in self.known:
            return self.known[system, user]
        for k in range(self.attempts):
            try:
                answer = self.inner.complete(system, user)
                break
            except Exception:
                if k + 1 == self.attempts:
                    raise
                time.sleep(self.delay * 2**k)
        if len(self.known) >= self.most:
            self.known.pop(next(iter(self.known)))
        self.known[system, user] = answer
        return answer


def answered(rows: DataFrame, make: Callable[[], Completer], system: str = "system", user: str = "user", out: str = "response") -> DataFrame:
    """rows with the answer to each prompt; one completer is made for each task. A null prompt has a null answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()
        for batch in batches:
            pairs = zip(batch[system], batch[user], strict=True)
            yield batch.assign(**{out: [None if u is None else one.complete(s or "", u) for s, u in pairs]})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))


@dataclass
class Scripted:
    """Answers in the form that an operator's instruction asks for, made from the prompt alone, so that readers can be tried offline."""

    reads: str

    def complete(self, system: str, user: str) -> str:
        parts = re.split(r"(?<=[.!?])\s+", user.strip())
        n = len(user)
        answers = {
            "text": "" if n % 5 == 0 else f"Sure.\nREWRITE: {parts[0]}",
            "variants": "No idea." if n % 5 == 0 else "Here:\n" + "\n".join(f"VAR: {p}" for p in parts[:3]),
            "score": "Hard to say." if n % 5 == 0 else f'```json\n{{"score": {n % 9}, "reason": "so"}}\n```',
            "verdict": "Perhaps." if n % 5 == 0 else f'{{"ok": {"true" if n % 2 else "false"}, "confidence": 0.{n % 9}}}',
            "choice": ("NONE fits", "I take B.", "candidate C", "no letter here", "A")[n % 5],
            "plan": "none" if n % 5 == 0 else f'[{{"action": "delete", "at": {n % 4}}}, {{"action": "dance", "at": 1}}, {{"action": "split", "at": 1}}]',
            "roles": "?" if n % 5 == 0 else 'Roles: ["OPEN", "TURN"]',
            "slots": "" if n % 5 == 0 else "\n".join(parts[: 1 + n % 4]),
        }
        return answers[self.reads]


def instruction(kind: str, **values: object) -> str:
    """The instruction of an operator with its values filled in; unknown ones are an error."""
    return told({"summary": "neutral_summary", "plan": "plan_content", "variants": "sentence_variants", "judge": "rank_candidates"}.get(kind, kind), **values)
