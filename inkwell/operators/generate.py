"""Loops around a text generator: each attempt reads only the rows that no earlier attempt has settled, from a table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..complete import Completer, answered, instruction
from ..functions import compare as cp
from ..functions import feedback as fb
from ..functions import gates as gt
from ..functions import judge as jd
from ..functions import rewrite as rw
from ..functions import structure as sr
from ..functions import text as tx
from ..sources.shared import kept

#: How strictly attempts are judged, in order, and the least score of each.
LADDER = (("strict", 0.75), ("loose", 0.6), ("safety", 0.0))


def verdict(original: Column, generated: Column) -> Column:
    """(passed, kind, score): prechecks in order, empty, length, completeness, repetition, dangling clause, lost content; then the weighed score."""
    ratio = gt.length_ratio(generated, original)
    covered = F.coalesce(jd.soft_coverage(original, generated)["coverage"], F.lit(1.0))
    repeats = gt.repetitive(generated)
    kind = (
        F.when(F.coalesce(tx.strip(generated), F.lit("")) == "", "empty")
        .when(gt.length_gate(ratio) != "pass", gt.length_gate(ratio))
        .when(~gt.complete(generated), "grammar")
        .when(repeats["pairs"] | repeats["starts"], "repetition")
        .when(jd.incomplete_clause(generated).isNotNull(), "clause")
        .when(covered < 0.8, "coverage")
        .otherwise("ok")
    )
    score = F.round((2 * cp.recall(original, generated) + cp.precision(original, generated, F.array().cast("array<string>")) + jd.fluency(generated)) / 4, 6)
    return tx.let(kind, lambda k: F.struct((k == "ok").alias("passed"), k.alias("kind"), score.alias("score")))


def _tried(original: Column, at: int, mode: str, least: float) -> Callable[[Column], Column]:
    """The tries so far and one more, as a function of the cleaned answer."""

    def more(clean: Column) -> Column:
        def one(v: Column) -> Column:
            # the last rank of the ladder overlooks what is not a matter of meaning
            passes = (v["passed"] | (F.lit(mode == "safety") & ~v["kind"].isin("empty", "meaning"))) & (v["score"] >= least)
            return F.concat("_tries", F.array(F.struct(v["score"].alias("score"), F.lit(-at).alias("at"), clean.alias("generated"), v["kind"].alias("kind"), F.lit(mode).alias("mode"), passes.alias("taken"))))

        return tx.let(verdict(original, clean), one)

    return more


def frontier(rows: DataFrame, rounds: int, attempt: Callable[[DataFrame, int], DataFrame], open_: Column) -> DataFrame:
    """rows after up to `rounds` attempts, each on the rows that are still open.

    Every round reads its rows from the table that the last one wrote, so no
    settled row goes to a generator, an answer that was paid for is not asked
    for again when executors are lost, and plans do not grow with the rounds.
    """
    now = kept(rows, "frontier")
    settled = []
    for r in range(rounds):
        live = now.where(open_)
        if live.isEmpty():
            break
        settled.append(now.where(~open_))
        now = kept(attempt(live, r), "frontier")
    return reduce(DataFrame.unionByName, settled, now)


def with_critic(rows: DataFrame, make: Callable[[], Completer], text: str = "text", ladder: Sequence[tuple[str, float]] = LADDER) -> DataFrame:
    """rows with what a generator made of the text: generated, mode, kind, score, attempts.

    An attempt is taken if it passes its prechecks and scores enough for its
    mode; a row that none settles keeps its best-scored attempt, the first of
    equals. What the last attempt lacked is told in the next one's prompt.
    """
    kind = "array<struct<score: double, at: int, generated: string, kind: string, mode: string, taken: boolean>>"

    def attempt(live: DataFrame, at: int) -> DataFrame:
        mode, least = ladder[at]
        asked = live.withColumn("_system", F.concat(F.lit(f"{mode}: " + instruction("polish", style="plain") + " "), F.col("_why")))
        got = answered(asked, make, "_system", text, "_answer")
        tries = F.when(F.col("_answer").isNotNull(), tx.let(rw.clean_generated(F.col("_answer")), _tried(F.col(text), at, mode, least))).otherwise(F.col("_tries"))
        return got.withColumn("_tries", tries).withColumn("_why", F.coalesce(F.concat(F.lit("Mend: "), F.element_at("_tries", -1)["kind"]), F.lit(""))).drop("_system", "_answer")

    start = rows.withColumn("_tries", F.array().cast(kind)).withColumn("_why", F.lit(""))
    done = frontier(start, len(ladder), attempt, ~F.exists("_tries", lambda t: t["taken"]))
    taken = F.get(F.filter("_tries", lambda t: t["taken"]), F.lit(0))
    best = F.coalesce(taken, F.array_max("_tries"))
    return done.withColumn("_b", best).select(*rows.columns, F.col("_b.generated").alias("generated"), F.when(taken.isNotNull(), F.col("_b.mode")).otherwise("none").alias("mode"), F.col("_b.kind").alias("kind"), F.col("_b.score").alias("score"), F.size("_tries").alias("attempts"))


def evolved(rows: DataFrame, make: Callable[[], Completer], original: str = "original", draft: str = "draft", generations: int = 3, enough: float = 0.95) -> DataFrame:
    """rows with the best draft of some generations: text, score, generation.

    Each generation is told to add what is missing, to mend the grammar or to
    polish, as the best draft so far needs it, and replaces it only if it
    scores better; a row that scores enough, or did not improve twice, asks no more.
    """
    score = lambda c: F.round(sr.raw_score(cp.recall(F.col(original), c), jd.fluency(c)), 6)

    def attempt(live: DataFrame, g: int) -> DataFrame:
        need = fb.diagnosis(cp.recall(F.col(original), F.col("text")), jd.fluency(F.col("text")))
        system = F.when(need == "semantic_injection", instruction("inject", words="all")).when(need == "grammar_repair", instruction("grammar")).otherwise(instruction("polish", style="plain"))
        asked = live.withColumn("_system", system).withColumn("_user", F.concat_ws(" ", F.col("text"), F.col(original)))
        got = answered(asked, make, "_system", "_user", "_answer").withColumn("_new", rw.clean_generated(F.col("_answer"))).withColumn("_s", score(F.col("_new")))
        better = F.coalesce(F.col("_s") > F.col("score"), F.lit(False))
        return got.select(*rows.columns, F.when(better, F.col("_new")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("_s")).otherwise(F.col("score")).alias("score"), F.when(better, g + 1).otherwise(F.col("generation")).alias("generation"), F.when(better, 0).otherwise(F.col("_idle") + 1).alias("_idle"))

    start = rows.withColumn("text", F.col(draft)).withColumn("score", score(F.col(draft))).withColumn("generation", F.lit(0)).withColumn("_idle", F.lit(0))
    live = F.coalesce((F.col("score") < enough) & (F.col("_idle") < 2), F.lit(False))
    return frontier(start, generations, attempt, live).drop("_idle")


def arena(candidates: DataFrame, by: str, key: str, k: int = 5, structure: float = 0.7, least: float = 0.5, alike: float = 0.85, viable: float = 0.85) -> DataFrame:
    """The candidates of each group that go on, ranked: by style among those that keep the meaning, else by recall.

    candidates: by, key, adherence, logic_fail, recall, similarity, leaked, density. Those that stray from
    their structure, fail in logic or lose most content (unless they are alike enough) drop out.
    """
    alive = candidates.where((F.col("adherence") >= structure) & ~F.col("logic_fail") & ((F.col("recall") >= least) | (F.col("similarity") > alike)))
    valid = (F.col("recall") >= viable) & ~F.col("leaked")
    told = alive.withColumn("valid", valid).withColumn("_any", F.max(valid).over(Window.partitionBy(by)))
    order = Window.partitionBy(by).orderBy(F.when(F.col("_any"), F.col("density")).otherwise(F.col("recall")).desc(), key)
    kept = told.where(F.col("valid") | ~F.col("_any")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select(by, key, "rank", F.when(F.col("_any"), "style").otherwise("repair").alias("ranked_by"))
