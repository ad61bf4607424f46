"""Workspace plumbing as queries: entitlements, job selection, retries, usage cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entitlements(grants: DataFrame, workspace: str, feature: str, limit: str) -> DataFrame:
    """The most generous limit of each workspace and feature; no limit beats any."""
    free = F.bool_or(F.col(limit).isNull())
    return grants.groupBy(workspace, feature).agg(F.when(~free, F.max(limit)).alias("limit"))


def next_jobs(jobs: DataFrame, queue: str, order: list[Column], claimable: Column) -> DataFrame:
    """The job each queue's worker would claim. Selection only: claiming needs a lock manager."""
    rest = [c for c in jobs.columns if c != queue]
    return jobs.where(claimable).groupBy(queue).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_j")).select(queue, *[F.col("_j")[c].alias(c) for c in rest])


def retry_after(attempt: Column, base_seconds: int = 30) -> Column:
    """Seconds to wait before an attempt: doubled each time."""
    return F.lit(base_seconds) * F.pow(F.lit(2), attempt - 1).cast("long")


def usage_cost(usage: DataFrame, rates: DataFrame, key: str) -> DataFrame:
    """usage with cost; null where no rate is known. Rates are a small dimension and Spark sees their size."""
    return usage.join(rates, key, "left").withColumn("cost", F.col("input_tokens") / 1e6 * F.col("input_rate") + F.col("output_tokens") / 1e6 * F.col("output_rate"))


def finished(state: Column, failed: Column, attempts: Column, most: Column) -> Column:
    """A job's next state: done, queued again while attempts are left, else failed. Only running jobs change."""
    return F.when(state != "running", state).when(~failed, "succeeded").when(attempts < most, "queued").otherwise("failed")


def fresh_only(found: DataFrame, held: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What is not in held already, each key once (the first by order): an append that may be repeated."""
    rest = [c for c in found.columns if c not in keys]
    once = found.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
    return once.join(held.select(*keys).distinct(), keys, "left_anti")


def stale_stages(expected: DataFrame, stored: DataFrame, keys: list[str], print_: str) -> DataFrame:
    """Stages whose stored fingerprint is not the expected one, or is not there."""
    was = stored.select(*keys, F.col(print_).alias("_was"))
    return expected.join(was, keys, "left").where(~F.col(print_).eqNullSafe(F.col("_was"))).drop("_was")


def workspace_features(grants: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """workspace, feature, limit: what each workspace holds now; the most generous limit wins, no limit beats any.

    grants: workspace, feature, plan, allowed, valid_from, valid_until (open if
    null). A grant gives its feature, its plan's features (plans: plan, feature,
    allowed), or both; one that has not begun or has ended gives nothing.
    """
    valid = grants.where((F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") > now)))
    direct = valid.where("feature IS NOT NULL").select("workspace", "feature", "allowed")
    # a plan counts once for a workspace, however often it was granted
    planned = valid.where("plan IS NOT NULL").select("workspace", "plan").distinct().join(plans.select("plan", "feature", "allowed"), "plan").select("workspace", "feature", "allowed")
    return entitlements(direct.unionByName(planned), "workspace", "feature", "allowed")


def within_quota(requests: DataFrame, features: DataFrame) -> DataFrame:
    """requests (workspace, feature, used) with state: no_entitlement, limit_reached or allowed."""
    held = features.select("workspace", "feature", "limit", F.lit(True).alias("_has"))
    state = F.when(F.col("_has").isNull(), "no_entitlement").when(F.col("used") >= F.col("limit"), "limit_reached").otherwise("allowed")
    return requests.join(held, ["workspace", "feature"], "left").withColumn("state", state).drop("_has", "limit")


def cancelled(jobs: DataFrame, asked: DataFrame, key: str, status: str) -> DataFrame:
    """jobs, those asked for and still queued cancelled; what runs or has ended stays."""
    marks = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    gone = F.coalesce("_asked", F.lit(False)) & (F.col(status) == "queued")
    return jobs.join(marks, key, "left").withColumn(status, F.when(gone, "cancelled").otherwise(F.col(status))).drop("_asked")


def lost_jobs(jobs: DataFrame, status: str, beat: str, now: Column, seconds: int) -> DataFrame:
    """Running jobs that have not been heard of for `seconds`, or never."""
    return jobs.where((F.col(status) == "running") & (F.col(beat).isNull() | (F.col(beat) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))))


def put_if_current(held: DataFrame, puts: DataFrame, key: str, version: str, body: str) -> tuple[DataFrame, DataFrame]:
    """(held after the puts, refused puts): a put counts if its version is the one held, which then goes up by one.

    Of several puts for one key in a batch, the first by `line` counts. A put of
    an unknown key is refused.
    """
    now = held.select(key, F.col(version).alias("_held"))
    judged = puts.join(now, key, "left").withColumn("_fits", F.coalesce(F.col(version) == F.col("_held"), F.lit(False)))
    taken = judged.where("_fits").groupBy(key).agg(F.min_by(F.struct(F.col(body).alias("b"), "line"), "line").alias("_p"))
    after = held.join(taken, key, "left").select(*[F.when(F.col("_p").isNotNull(), F.col(version) + 1).otherwise(F.col(version)).alias(c) if c == version else F.when(F.col("_p").isNotNull(), F.col("_p.b")).otherwise(F.col(body)).alias(c) if c == body else F.col(c) for c in held.columns])
    winners = taken.select(key, F.col("_p.line").alias("_line"))
    refused = judged.join(winners, key, "left").where(~F.coalesce(F.col("_fits") & (F.col("line") == F.col("_line")), F.lit(False))).select(*puts.columns)
    return after, refused


def prescribed(held: DataFrame, asked: DataFrame, levers: list[str]) -> DataFrame:
    """asked (lever, page, target, value, from_page, line) with outcome: applied, repeated or refused, and why.

    An override of an unknown lever or of another page than the one it was made
    on is refused. Where the loop has set the same target before (held: lever,
    target, value; or an earlier line of this batch that was applied), the same
    value is a repeat, another one would flip it and is refused.
    """
    known = F.col("lever").isin(*levers) & F.col("value").isNotNull()
    scoped = F.col("page").isNull() | (F.col("page") == F.col("from_page"))
    before = held.groupBy("lever", "target").agg(F.collect_set("value").alias("_values"))
    first = asked.where(known & scoped).groupBy("lever", "target").agg(F.min_by("value", "line").alias("_first"), F.min("line").alias("_line"))
    state = asked.join(before, ["lever", "target"], "left").join(first, ["lever", "target"], "left")
    set_before = F.col("_values").isNotNull()
    same = F.when(set_before, F.array_contains("_values", F.col("value"))).otherwise(F.col("value") == F.col("_first"))
    why = F.when(~known, "unknown lever").when(~scoped, "other page").when((set_before | (F.col("line") > F.col("_line"))) & ~same, "flips")
    outcome = F.when(why.isNotNull(), "refused").when(set_before | (F.col("line") > F.col("_line")), "repeated").otherwise("applied")
    return state.select(*asked.columns, outcome.alias("outcome"), why.alias("why"))
