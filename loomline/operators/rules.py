"""Decisions as ordered conditions: portability, routes, fallbacks, costs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NANOS = 1_000_000_000


def portability(targets: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, status, n, sendable) from targets (thread_id, sendable, transformed); a thread without targets is unknown."""
    n = targets.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("sendable").alias("sendable"), F.max("transformed").alias("changed"))
    j = threads.select("thread_id").join(n, "thread_id", "left").fillna(0, ["n", "sendable"])
    status = (
        F.when(F.col("n") == 0, "unknown").when(F.col("sendable") == 0, "blocked").when(F.col("sendable") < F.col("n"), "provider_dependent")
        .when(F.col("changed"), "portable_with_transformations").otherwise("fully_portable")
    )
    return j.select("thread_id", status.alias("status"), "n", "sendable")


def status_counts(assessed: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every known status with its number of threads, zero where none."""
    n = assessed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(statuses).join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def disqualified(c: DataFrame) -> Column:
    """Why a candidate row may not be taken, null if it may; the first reason that holds.

    Reads configured, has_model, position, private_change, allow_change, blocked, needs_tools,
    tools, needs_images, images, region_ok, needs_context, context, cost_ok.
    """
    reasons = (
        ("not_configured", ~c.configured), ("no_model", ~c.has_model), ("privacy", (c.position > 0) & c.private_change & ~c.allow_change),
        ("health", c.blocked), ("tools", c.needs_tools & ~c.tools), ("images", c.needs_images & ~c.images), ("region", ~c.region_ok),
        ("context", c.needs_context.isNotNull() & (c.context.isNull() | (c.context < c.needs_context))), ("cost", ~c.cost_ok),
    )
    return F.coalesce(*[F.when(holds, name) for name, holds in reasons])


def route(candidates: DataFrame) -> DataFrame:
    """(request, chosen, position): the first candidate that qualifies and can carry the path (sendable); ties of position go to the smaller one.

    A first candidate that fails only by not carrying the path is taken if no other qualifies; else null.
    """
    c = candidates.withColumn("reason", disqualified(candidates))
    good = F.col("reason").isNull() & F.col("sendable")
    waiting = F.col("reason").isNull() & ~F.col("sendable") & (F.col("position") == 0)
    order = F.when(good, F.struct(F.lit(0), "position", "candidate")).when(waiting, F.struct(F.lit(1), "position", "candidate"))
    return c.groupBy("request").agg(F.min_by(F.when(order.isNotNull(), F.col("candidate")), order).alias("chosen"), F.min_by("position", order).alias("position"))


def fallback(attempts: DataFrame) -> DataFrame:
    """(id, apply, reason) of attempts (id, status, configured, has_model, same_target, private_change, allow_change, blocked, sendable)."""
    a = attempts
    reason = (
        F.when(a.status.isin("cancelled", "stopped"), "stopped_by_user").when(a.status == "complete", "completed").when(~a.configured, "not_configured").when(~a.has_model, "no_model")
        .when(a.same_target, "same_target").when(a.private_change & ~a.allow_change, "privacy").when(a.blocked, "health").when(~F.coalesce(a.sendable, F.lit(False)), "cannot_carry").otherwise("apply")
    )
    return a.select("id", (reason == "apply").alias("apply"), reason.alias("reason"))


def omitted_reasoning(parts: DataFrame, turns: DataFrame, model: str, verifies: bool) -> DataFrame:
    """(thread_id, unverified, foreign): reasoning parts a target would not get.

    parts: thread_id, turn, reasoned_by (null if unverified), one a reasoning part of an assistant
    turn. turns: thread_id, turn, next_is_tool; a turn that a tool result follows keeps its parts.
    """
    j = parts.join(turns.where("NOT next_is_tool"), ["thread_id", "turn"], "left_semi")
    unverified = F.col("reasoned_by").isNull()
    foreign = ~unverified & ((F.col("reasoned_by") != model) | F.lit(not verifies))
    return j.groupBy("thread_id").agg(F.count_if(unverified).alias("unverified"), F.count_if(foreign).alias("foreign")).where("unverified + foreign > 0")


def nanos(price: Column) -> Column:
    """A decimal string of at most nine digits on each side in billionths; null if it is not one."""
    return F.when(price.rlike(r"^\d{1,9}(\.\d{1,9})?$"), (price.cast("decimal(18,9)") * NANOS).cast("decimal(38,0)"))


def spend(tokens: Column, rate: Column) -> Column:
    return tokens.cast("decimal(18,0)") * rate


def upward(millionths: Column) -> Column:
    """Prices are per million tokens: divided by a million and rounded up to a billionth."""
    return F.ceil(millionths.cast("decimal(38,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")


def cost_gate(requests: DataFrame) -> DataFrame:
    """(id, allowed, basis, input_nanos, total_nanos) of requests.

    Reads counted and context (tokens), most_output, input_rate and output_rate (decimal strings a
    million), input_cap and total_cap. The counted tokens are taken, else the context window; a
    request with a cap but without a sound price or count is refused, and so is a currency, if that
    column is there, other than USD.
    """
    r = requests
    i_rate, o_rate, i_cap, t_cap = nanos(r.input_rate), nanos(r.output_rate), nanos(r.input_cap), nanos(r.total_cap)
    tokens = F.coalesce(r.counted, r.context)
    free = r.input_cap.isNull() & r.total_cap.isNull()
    unsound = (
        (r.input_cap.isNotNull() & i_cap.isNull()) | (r.total_cap.isNotNull() & t_cap.isNull()) | i_rate.isNull() | o_rate.isNull()
        | F.coalesce(r.most_output <= 0, F.lit(True)) | tokens.isNull() | F.coalesce(r.context <= 0, F.lit(False))
        | F.coalesce(r.counted < 0, F.lit(False)) | F.coalesce(r.counted > r.context, F.lit(False))
    )
    if "currency" in r.columns:
        unsound = unsound | ~r.currency.eqNullSafe("USD")
    inner = spend(tokens, i_rate)
    rated = F.when(~free & ~unsound, upward(inner)), F.when(~free & ~unsound, upward(inner + spend(r.most_output, o_rate)))
    basis = F.when(free | unsound, "unavailable").when(r.counted.isNotNull(), "counted").otherwise("context_bound")
    fits = F.coalesce(rated[0] <= i_cap, r.input_cap.isNull()) & F.coalesce(rated[1] <= t_cap, r.total_cap.isNull())
    return r.select("id", F.when(free, True).when(unsound, False).otherwise(fits).alias("allowed"), basis.alias("basis"), rated[0].cast("long").alias("input_nanos"), rated[1].cast("long").alias("total_nanos"))


def show_amount(amount: Column) -> Column:
    """A decimal string without trailing zeros beyond two decimals; anything else as it is."""
    whole, fraction = F.split_part(amount, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(amount, F.lit("."), F.lit(2)), "0+$", "")
    padded = F.when(F.length(fraction) < 2, F.rpad(fraction, 2, "0")).otherwise(fraction)
    return F.when(amount.rlike(r"^\d+(\.\d+)?$"), F.concat(whole, F.lit("."), padded)).otherwise(amount)


def stream_usage(events: DataFrame) -> DataFrame:
    """(stream, input_tokens, output_tokens) of ordered usage events; a later value of a field replaces an earlier one.

    events: stream, ordinal, shape and the counts prompt, completion (counted shape) or uncached,
    cache_read, cache_written, output (split shape), null where an event does not name them. The
    split shape's input is the sum of its three parts and unknown without the first.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)
    g = events.groupBy("stream", "shape").agg(*[last(c) for c in ("prompt", "completion", "uncached", "cache_read", "cache_written", "output")])
    split = F.col("uncached") + F.coalesce("cache_read", F.lit(0)) + F.coalesce("cache_written", F.lit(0))
    counted = F.col("shape") == "counted"
    return g.select("stream", F.when(counted, F.col("prompt")).otherwise(split).alias("input_tokens"), F.when(counted, F.col("completion")).otherwise(F.col("output")).alias("output_tokens"))
