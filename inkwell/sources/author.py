"""An author's artefacts built stage by stage, each stage's failure told and not hidden."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import measure as ms
from .store import read_texts, save

Stage = tuple[str, Callable[[], object]]


@dataclass(frozen=True)
class Outcome:
    """A stage's name, whether it ran, and its error."""

    name: str
    ok: bool
    error: str = ""


def run_stages(stages: Sequence[Stage], *, skip: Sequence[str] = ()) -> list[Outcome]:
    """Run stages in order, without those to skip; the first failure ends the run and is the last outcome."""
    out: list[Outcome] = []
    for name, stage in stages:
        if name in skip:
            continue
        try:
            stage()
        except Exception as e:  # told to the caller
            out.append(Outcome(name, False, f"{type(e).__name__}: {e}".splitlines()[0]))
            break
        out.append(Outcome(name, True))
    return out


def artefacts(docs: DataFrame) -> dict[str, DataFrame]:
    """What is kept of an author: windows of three sentences, paragraphs with features, fragments and the style profile."""
    rows = tx.paragraph_rows(docs)
    cut = lambda step, name: rows.select("source", "doc_id", "para_idx", F.posexplode(tx.windows(tx.sentences(F.col("paragraph")), 3, step)).alias(name, "_w")).select("source", "doc_id", "para_idx", name, F.array_join("_w", " ").alias("text"))
    return {"windows": cut(1, "window_idx"), "paragraphs": ms.paragraph_features(rows), "fragments": cut(2, "fragment_index"), "profile": ms.profile(tx.sentence_rows(docs))}


def build_author(spark: SparkSession, author: str, texts: str, store: str, *, skip: Sequence[str] = ()) -> list[Outcome]:
    """Read an author's text files and replace the author's part of every collection under `store`."""
    made = artefacts(read_texts(spark, texts, author))
    return run_stages([(name, lambda rows=rows, name=name: save(rows, f"{store.rstrip('/')}/{name}")) for name, rows in made.items()], skip=skip)
