"""Learning from feedback and past decisions.

``feedback``: (feedback_id, ts, target_type, target_id, is_correct, user_correction);
``decisions``: (decision_id, session_id, agent, confidence).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expressions import bands
from plumbline.operators.ordering import positions

c = F.col
CONFIDENCE_FLOOR, CONFIDENCE_CEILING = 0.5, 0.99
FALSE_POSITIVE_STEP, CONFIRMATION_STEP = 0.05, 0.02
TOLERATED_FALSE_POSITIVES = 5
FOLD = 10_000  # longest run composed by one task


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """(target_type, total, positive, negative, positive_rate) by type and overall (type null)."""
    rows = feedback.rollup("target_type").agg(
        F.count(F.lit(1)).alias("total"), _count(c("is_correct")).alias("positive"), _count(~c("is_correct")).alias("negative")
    )
    return rows.withColumn("positive_rate", F.when(c("total") > 0, c("positive") / c("total")))


def success_band(rate: Column) -> Column:
    return bands(rate, [(0.8, "high_confidence"), (0.6, "normal_confidence"), (0.4, "verify")], "caution")


def learn(feedback: DataFrame, by: str) -> DataFrame:
    """Per group of similar feedback: success rate, confidence shift, recommendation, past corrections.

    Past corrections are the first three (by time) of refused targets, kept by an aggregate that
    never holds more than the groups' minima.
    """
    rows = feedback.groupBy(by).agg(
        F.count(F.lit(1)).alias("feedback_count"), _count(c("is_correct")).alias("positive_count"), _count(~c("is_correct")).alias("negative_count"),
        F.min(F.when(~c("is_correct") & c("user_correction").isNotNull(), F.struct("ts", "feedback_id", "user_correction"))).alias("_first"),
    )
    judged = c("positive_count") + c("negative_count")
    rate = F.when(judged > 0, c("positive_count") / judged)
    rows = rows.withColumn("_rate", rate)
    return rows.select(
        by, "feedback_count", "positive_count", "negative_count", F.round("_rate", 3).alias("success_rate"),
        F.coalesce(F.round((c("_rate") - 0.5) * 0.3, 3), F.lit(0.0)).alias("confidence_adjustment"),
        F.when(c("_rate").isNotNull(), success_band(c("_rate"))).otherwise("not_enough_feedback").alias("recommendation"),
        c("_first.user_correction").alias("first_correction"),
    )


def past_corrections(feedback: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The first ``k`` user corrections of refused targets per group."""
    order = W.partitionBy(by).orderBy("ts", "feedback_id")
    refused = feedback.where(~c("is_correct") & c("user_correction").isNotNull())
    return refused.withColumn("place", F.row_number().over(order)).where(c("place") <= k).select(by, "place", "user_correction")


def confidence_fold(feedback: DataFrame, check: str = "target_type", before: DataFrame | None = None) -> DataFrame:
    """(check_type, confidence, false_positives, confirmations) after all feedback in time order, from the same table ``before`` it on.

    Each false positive after the fifth takes 0.05 (not below 0.5); each confirmation gives 0.02
    (not above 0.99). One step is x -> min(hi, max(lo, x + shift)), and such steps compose to a step
    of the same form. So runs of at most FOLD events are composed in parallel, then runs of at most
    FOLD of those results, and so on: a check with most of the feedback is never one list.
    """
    events = positions(
        feedback.where(c("is_correct").isNotNull()).select(c(check).alias("check_type"), "ts", "feedback_id", c("is_correct").alias("ok")),
        ["check_type", "ts", "feedback_id"],
    )
    first = W.partitionBy("check_type").orderBy("position")
    early = events.where(~c("ok")).withColumn("_place", F.row_number().over(first)).where(c("_place") <= TOLERATED_FALSE_POSITIVES)
    if before is not None:
        early = early.join(before.select("check_type", "false_positives"), "check_type", "left").where(c("_place") <= TOLERATED_FALSE_POSITIVES - F.coalesce("false_positives", F.lit(0)))
    tolerated = early.groupBy("check_type").agg(F.max("position").alias("_free_until"))
    infinite = float("inf")
    acting = events.join(tolerated, "check_type", "left").where(c("ok") | (c("position") > F.coalesce("_free_until", F.lit(-1))))
    level = acting.select("check_type", c("position").alias("at"), F.struct(
        F.when(c("ok"), CONFIRMATION_STEP).otherwise(-FALSE_POSITIVE_STEP).alias("shift"),
        F.when(c("ok"), -infinite).otherwise(CONFIDENCE_FLOOR).alias("lo"), F.when(c("ok"), CONFIDENCE_CEILING).otherwise(infinite).alias("hi"),
    ).alias("f"))
    longest = level.agg(F.max("at")).first()[0] or 0
    while True:  # until each check has one run left
        level = level.groupBy("check_type", F.floor(c("at") / FOLD).alias("run")).agg(
            F.array_sort(F.collect_list(F.struct("at", "f"))).alias("steps")  # at most FOLD entries
        ).select("check_type", c("run").alias("at"), _composed(c("steps")).alias("f"))
        longest //= FOLD
        if not longest:
            break
    counts = events.groupBy("check_type").agg(_count(~c("ok")).alias("false_positives"), _count(c("ok")).alias("confirmations"))
    moved = counts.join(level.select("check_type", "f"), "check_type", "left")
    start = F.lit(1.0)
    if before is not None:
        old = before.select("check_type", c("confidence").alias("_confidence"), c("false_positives").alias("_wrong"), c("confirmations").alias("_right"))
        zero = F.lit(0).cast("long")
        moved = moved.join(old, "check_type", "full_outer").withColumns({"false_positives": F.coalesce("false_positives", zero) + F.coalesce("_wrong", zero), "confirmations": F.coalesce("confirmations", zero) + F.coalesce("_right", zero)})
        start = F.coalesce("_confidence", F.lit(1.0))
    end = F.when(c("f").isNull(), start).otherwise(F.round(F.least(c("f.hi"), F.greatest(c("f.lo"), start + c("f.shift"))), 4))
    return moved.select("check_type", end.alias("confidence"), "false_positives", "confirmations")


def _composed(steps: Column) -> Column:
    """One clamped shift equal to the listed ones, applied one after another."""
    infinite = float("inf")
    start = F.struct(F.lit(0.0).alias("shift"), F.lit(-infinite).alias("lo"), F.lit(infinite).alias("hi"))

    def then(s: Column, e: Column) -> Column:
        f = e["f"]

        def clamp(v: Column) -> Column:
            return F.least(f["hi"], F.greatest(f["lo"], v))

        return F.struct(
            (s["shift"] + f["shift"]).alias("shift"), clamp(s["lo"] + f["shift"]).alias("lo"), clamp(s["hi"] + f["shift"]).alias("hi")
        )

    return F.aggregate(steps, start, then)


def feedback_summary(feedback: DataFrame) -> DataFrame:
    judged = c("is_correct").isNotNull()
    return feedback.agg(
        _count(~c("is_correct")).alias("false_positives"), _count(c("is_correct")).alias("confirmations"), _count(c("user_correction").isNotNull()).alias("examples_added"),
        F.count_distinct(F.when(judged & c("is_correct"), c("target_type"))).alias("checks_confirmed"),
    )


def adjusted_issues(issues: DataFrame, fold: DataFrame) -> DataFrame:
    """Issue confidence times the learned confidence of its kind of target."""
    factor = fold.where(c("check_type") == "issue").select("confidence").scalar()
    return issues.withColumn("confidence", c("confidence") * F.coalesce(factor, F.lit(1.0)))


def rules_from_feedback(feedback: DataFrame) -> DataFrame:
    """Exception rules from false positives and example rules from user corrections."""
    def rules(rows: DataFrame, kind: str, text: Column) -> DataFrame:
        return rows.select(
            F.concat_ws("_", F.lit(kind), c("feedback_id").cast("string")).alias("rule_id"), text.alias("text"), F.lit(kind).alias("rule_type"),
            F.lit("low").alias("severity"), F.lit("feedback").alias("category"), F.lit(True).alias("active"),
        )

    wrong = rules(feedback.where(~c("is_correct")), "exception", F.concat_ws(" ", F.lit("false positive:"), c("target_type"), c("target_id").cast("string")))
    given = rules(feedback.where(c("user_correction").isNotNull()), "example", F.concat_ws(" ", F.lit("correction:"), c("target_type"), c("user_correction")))
    return wrong.unionByName(given)


def latest_verdicts(feedback: DataFrame, target_type: str = "decision") -> DataFrame:
    """(target_id, was_correct): the last feedback per target."""
    rows = feedback.where((c("target_type") == target_type) & c("is_correct").isNotNull())
    return rows.groupBy("target_id").agg(F.max_by("is_correct", F.struct("ts", "feedback_id")).alias("was_correct"))


def mark_decisions(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Decisions with ``was_correct`` from their latest feedback, null without any."""
    verdicts = latest_verdicts(feedback).withColumnRenamed("target_id", "decision_id")
    return decisions.join(verdicts, "decision_id", "left")


def decision_accuracy(marked: DataFrame) -> DataFrame:
    rows = marked.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total_decisions"), _count(c("was_correct")).alias("correct"), _count(~c("was_correct")).alias("incorrect"),
        _count(c("was_correct").isNull()).alias("unknown"),
    )
    judged = c("correct") + c("incorrect")
    return rows.withColumn("accuracy", F.when(judged > 0, c("correct") / judged))


def confidence_shift(matches: DataFrame, by: str) -> DataFrame:
    """(by, adjustment) from similar decisions (similarity, was_correct): (weighted share - 0.5) * 0.4."""
    rows = matches.where(c("was_correct").isNotNull()).groupBy(by).agg(
        F.sum(F.when(c("was_correct"), c("similarity")).otherwise(0.0)).alias("right"), F.sum("similarity").alias("all")
    )
    return rows.select(by, F.when(c("all") != 0, F.round((c("right") / c("all") - 0.5) * 0.4, 3)).otherwise(0.0).alias("adjustment"))


def decisions_of_session(decisions: DataFrame, session_id: str) -> DataFrame:
    return decisions.where(c("session_id") == session_id)


def feedback_of_target(feedback: DataFrame, target_id: str) -> DataFrame:
    return feedback.where(c("target_id") == target_id)
