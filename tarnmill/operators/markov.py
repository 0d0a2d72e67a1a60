"""Sequence models: first-order Markov chains and models of order k.

A model is a table of transition counts. Counts of more sequences are added to it (`extend`), and
probabilities are read off it; start and end of a sequence are kinds of states, not values that an
item could equal.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import seeded
from ..staging import drop_staged, stage
from .sequences import following
from .skew import skew_join

SOS, EOS = "<SOS>", "<EOS>"


def transition_counts(seq: DataFrame) -> DataFrame:
    """(state, next, cnt): neighbours in the hosts' sequences, with SOS and EOS at the ends."""
    f = following(seq, 1, ["log"])
    pairs = f.select(F.col("log").alias("state"), F.coalesce(F.col("next1.log"), F.lit(EOS)).alias("next"))
    starts = seq.where("pos = 1").select(F.lit(SOS).alias("state"), F.col("log").alias("next"))
    return pairs.unionByName(starts).groupBy("state", "next").agg(F.count("*").alias("cnt"))


def extend(counts: DataFrame, more: DataFrame) -> DataFrame:
    """Counts of both; new states come in by themselves. Works on tables of (state, next, cnt) and of
    starts (state, cnt); other columns, such as probabilities, no longer hold and are left out."""
    keys = [c for c in ("state", "next") if c in counts.columns]
    both = counts.select(*keys, "cnt").unionByName(more.select(*keys, "cnt"))
    return both.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def probabilities(counts: DataFrame) -> DataFrame:
    """Counts with `prob`, the share of the state's transitions."""
    state = [c for c in counts.columns if c not in ("next", "cnt")]
    total = counts.groupBy(*state).agg(F.sum("cnt").alias("total"))
    return counts.join(total, state).select(*counts.columns, (F.col("cnt").cast("double") / F.col("total")).alias("prob"))


def subsequent_probability(probs: DataFrame, state) -> DataFrame:
    """(next, prob) after one state (a string, or a list of strings for order k), EOS included."""
    value = F.array(*map(F.lit, state)) if isinstance(state, (list, tuple)) else F.lit(state)
    return probs.where((F.col("state") == value) & (F.col("prob") > 0)).select("next", "prob")


def _score(steps: DataFrame) -> DataFrame:
    """(host, steps, log_prob, prob) of (host, times, prob)."""
    unseen = F.count(F.when(F.coalesce("prob", F.lit(0.0)) <= 0, 1))
    logs = F.sum(F.col("times") * F.log("prob"))
    out = steps.groupBy("host").agg(F.sum("times").alias("steps"), F.when(unseen == 0, logs).alias("log_prob"))
    return out.withColumn("prob", F.coalesce(F.exp("log_prob"), F.lit(0.0)))


def sequence_steps(seq: DataFrame, probs: DataFrame, start: bool = True) -> DataFrame:
    """(host, step, state, next, prob): each transition of each host's sequence, step 0 from SOS and the
    last to EOS; prob is 0 for a transition that the model lacks."""
    f = following(seq, 1, ["log"])
    pairs = f.select("host", F.col("pos").alias("step"), F.col("log").alias("state"), F.coalesce(F.col("next1.log"), F.lit(EOS)).alias("next"))
    if start:
        pairs = pairs.unionByName(seq.where("pos = 1").select("host", F.lit(0).alias("step"), F.lit(SOS).alias("state"), F.col("log").alias("next")))
    return pairs.join(probs.select("state", "next", "prob"), ["state", "next"], "left").select("host", "step", "state", "next", F.coalesce("prob", F.lit(0.0)).alias("prob"))


def sequence_probability(seq: DataFrame, probs: DataFrame, start: bool = True) -> DataFrame:
    """(host, steps, log_prob, prob) of each host's sequence under a first-order model. A transition
    that the model lacks makes prob 0 and log_prob null. Sums of logarithms, so no underflow there.
    Equal transitions of a host are merged before the model is joined."""
    f = following(seq, 1, ["log"])
    pairs = f.select("host", F.col("log").alias("state"), F.coalesce(F.col("next1.log"), F.lit(EOS)).alias("next"))
    if start:
        pairs = pairs.unionByName(seq.where("pos = 1").select("host", F.lit(SOS).alias("state"), F.col("log").alias("next")))
    used = pairs.groupBy("host", "state", "next").agg(F.count("*").alias("times"))
    return _score(used.join(probs.select("state", "next", "prob"), ["state", "next"], "left"))


def order_counts(seq: DataFrame, order: int = 2) -> DataFrame:
    """(state array<string>, next, cnt): what follows `order` items. EOS ends a sequence; sequences
    with fewer than `order` items have no state."""
    if not 1 <= order <= 5:
        raise ValueError("order must be from 1 to 5")
    f = following(seq, order, ["log"])
    items = [F.col("log")] + [F.col(f"next{j}.log") for j in range(1, order)]
    whole = f if order == 1 else f.where(F.col(f"next{order - 1}").isNotNull())
    return whole.groupBy(F.array(*items).alias("state"), F.coalesce(F.col(f"next{order}.log"), F.lit(EOS)).alias("next")).agg(F.count("*").alias("cnt"))


def start_counts(seq: DataFrame, order: int = 2) -> DataFrame:
    """(state array<string>, cnt): the first `order` items of the sequences that have so many."""
    first = following(seq.where(F.col("pos") <= order), order, ["log"]).where("pos = 1")
    if order > 1:
        first = first.where(F.col(f"next{order - 1}").isNotNull())
    state = F.array("log", *[F.col(f"next{j}.log") for j in range(1, order)])
    return first.groupBy(state.alias("state")).agg(F.count("*").alias("cnt"))


def start_shares(counts: DataFrame) -> DataFrame:
    """(state, cnt, prob) of start counts, of one fit or extended."""
    return counts.select("state", "cnt", (F.col("cnt").cast("double") / counts.agg(F.sum("cnt")).scalar()).alias("prob"))


def start_probabilities(seq: DataFrame, order: int = 2) -> DataFrame:
    """(state array<string>, cnt, prob): shares of the first `order` items of the sequences."""
    return start_shares(start_counts(seq, order))


def order_sequence_steps(seq: DataFrame, probs: DataFrame, starts: DataFrame | None, order: int = 2) -> DataFrame:
    """(host, step, prob): the start (step 0, left out without `starts`) and each step of the sequences
    with at least `order` items; prob is 0 for what the model lacks."""
    f = following(seq, order, ["log"])
    items = [F.col("log")] + [F.col(f"next{j}.log") for j in range(1, order)]
    whole = f if order == 1 else f.where(F.col(f"next{order - 1}").isNotNull())
    steps = whole.select("host", "pos", F.array(*items).alias("state"), F.coalesce(F.col(f"next{order}.log"), F.lit(EOS)).alias("next"))
    rest = steps.join(probs.select("state", "next", "prob"), ["state", "next"], "left").select("host", F.col("pos").alias("step"), "prob")
    if starts is not None:
        rest = rest.unionByName(steps.where("pos = 1").join(starts.select("state", "prob"), "state", "left").select("host", F.lit(0).alias("step"), "prob"))
    return rest.withColumn("prob", F.coalesce("prob", F.lit(0.0)))


def order_sequence_probability(seq: DataFrame, probs: DataFrame, starts: DataFrame | None, order: int = 2) -> DataFrame:
    """(host, log_prob, prob) of the sequences with at least `order` items: start (unless `starts` is
    None) times all steps. A start or step that the model lacks makes prob 0 and log_prob null. Sums
    of logarithms, so no underflow there."""
    return _score(order_sequence_steps(seq, probs, starts, order).withColumn("times", F.lit(1))).drop("steps")


def transition_matrix(counts: DataFrame, max_states: int = 5000) -> tuple[list[str], np.ndarray]:
    """States in order, and probabilities between them (SOS and EOS left out). The matrix is dense on
    the driver, so more than `max_states` states are refused."""
    probs = probabilities(counts).where((F.col("state") != SOS) & (F.col("next") != EOS))
    if counts.select("state").distinct().limit(max_states + 1).count() > max_states:
        raise ValueError("too many states for a dense matrix")
    rows = probs.collect()
    states = sorted({r["state"] for r in counts.select("state").where(F.col("state") != SOS).distinct().collect()} | {r["next"] for r in rows})
    at = {s: i for i, s in enumerate(states)}
    m = np.zeros((len(states), len(states)))
    for r in rows:
        m[at[r["state"]], at[r["next"]]] = r["prob"]
    return states, m


def stationary_distribution(counts: DataFrame, max_states: int = 5000) -> DataFrame:
    """(state, prob): the dominant left eigenvector between the items, summing to 1 (the
    distribution that is left unchanged among sequences that have not ended). Up to `max_states`
    states it comes from a dense matrix, beyond from rounds over the table of transitions."""
    if counts.select("state").distinct().limit(max_states + 1).count() > max_states:
        return _stationary_by_rounds(counts)
    states, m = transition_matrix(counts, max_states)
    values, vectors = np.linalg.eig(m.T)
    v = np.abs(vectors[:, int(np.argmax(values.real))].real)
    v = v / v.sum()
    return counts.sparkSession.createDataFrame(list(zip(states, map(float, v))), "state string, prob double")


def _stationary_by_rounds(counts: DataFrame, tolerance: float = 1e-10, max_rounds: int = 2000) -> DataFrame:
    """Power iteration by one join and one aggregate a round. Half of each round's distribution stays
    where it is, which leaves the eigenvector as it is and makes chains that go in circles settle."""
    steps = stage(probabilities(counts).where((F.col("state") != SOS) & (F.col("next") != EOS)).select("state", "next", F.col("prob").alias("p")), "steps")
    states = counts.select("state").where(F.col("state") != SOS).unionByName(steps.select(F.col("next").alias("state"))).distinct()
    now = stage(states.withColumn("prob", F.lit(1.0)), "stationary")
    for _ in range(max_rounds):
        total = now.agg(F.sum("prob")).first()[0] or 1.0
        now_ = now.withColumn("prob", F.col("prob") / F.lit(total))
        gone = steps.join(now_, "state").groupBy(F.col("next").alias("state")).agg(F.sum(F.col("p") * F.col("prob")).alias("into"))
        nxt = stage(now_.join(gone, "state", "left").select("state", F.col("prob").alias("old"), ((F.col("prob") + F.coalesce("into", F.lit(0.0))) / 2).alias("prob")), "stationary")
        drop_staged(now)
        size = nxt.agg(F.sum("prob")).first()[0] or 1.0
        change = nxt.agg(F.sum(F.abs(F.col("prob") / F.lit(size) - F.col("old")))).first()[0] or 0.0
        now = nxt.select("state", "prob")
        now._tarnmill_path = nxt._tarnmill_path
        if change < tolerance:
            break
    total = now.agg(F.sum("prob")).first()[0] or 1.0
    return now.select("state", (F.col("prob") / F.lit(total)).alias("prob"))


#: Most rows of a model that are brought to the driver to draw sequences from.
MODEL_ROWS = 1_000_000


def _draw(followers: list[tuple], seed: int, *at):
    """One of (value, count), in their order, by a number that the seed and the place fix."""
    u = int(hashlib.md5("|".join(map(str, (seed, *at))).encode()).hexdigest()[:15], 16) % sum(c for _, c in followers)
    for value, c in followers:
        u -= c
        if u < 0:
            return value


def _model(counts: DataFrame) -> dict:
    """state -> its (next, cnt) by next, on the driver; a model of more than MODEL_ROWS rows is refused."""
    if counts.limit(MODEL_ROWS + 1).count() > MODEL_ROWS:
        raise ValueError("the model is too large to draw from on the driver; draw with generate_by_steps")
    table: dict = {}
    for r in counts.orderBy("state", "next").collect():
        table.setdefault(tuple(r["state"]) if isinstance(r["state"], list) else r["state"], []).append((r["next"], r["cnt"]))
    return table


def generate(counts: DataFrame, number: int = 1, seed: int = 0, start: str | None = None, max_len: int = 1000) -> DataFrame:
    """(host, pos, log): `number` random sequences, each ending at EOS or at max_len items. The draw at
    each place is by the counts and by a hash of seed, sequence and place."""
    table, rows = _model(counts), []
    for host in range(number):
        state, pos = (SOS, 0) if start is None else (start, 1)
        if start is not None:
            rows.append((host, pos, start))
        while pos < max_len and state in table:
            state = _draw(table[state], seed, host, pos)
            if state == EOS:
                break
            pos += 1
            rows.append((host, pos, state))
    return counts.sparkSession.createDataFrame(rows, "host int, pos int, log string")


def generate_by_steps(counts: DataFrame, number: int = 1, seed: int = 0, max_len: int = 1000) -> DataFrame:
    """As `generate`, for a model or a number of sequences too large for the driver: all sequences take
    a step at a time, by a join with the ranges that the followers of each state have."""
    w = Window.partitionBy("state")
    upto = F.sum("cnt").over(w.orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
    ranges = stage(counts.select("state", "next", (upto - F.col("cnt")).alias("low"), upto.alias("high"), F.sum("cnt").over(w).alias("total")), "ranges")
    now = counts.sparkSession.range(number).select(F.col("id").cast("int").alias("host"), F.lit(0).alias("pos"), F.lit(SOS).alias("log"))
    parts = []
    for pos in range(max_len):
        u = F.pmod(seeded(seed, F.col("host"), F.col("pos")), F.col("total"))
        step = skew_join(now.withColumnRenamed("log", "state"), ranges, ["state"], "inner", number).where((u >= F.col("low")) & (u < F.col("high")) & (F.col("next") != EOS))
        now = stage(step.select("host", F.lit(pos + 1).alias("pos"), F.col("next").alias("log")), "steps")
        parts.append(now)
        if not now.take(1):
            break
    return reduce(DataFrame.unionByName, parts)


def generate_next(counts: DataFrame, state: str | list[str], seed: int = 0) -> str | None:
    """A random follower of a state (EOS may be one), by the counts; None for an unknown state. Only
    the rows of that state are brought to the driver."""
    value = F.array(*map(F.lit, state)) if isinstance(state, (list, tuple)) else F.lit(state)
    table = _model(counts.where(F.col("state") == value))
    return _draw(*table.values(), seed, "next") if table else None


def generate_order(counts: DataFrame, starts: DataFrame, number: int = 1, seed: int = 0, start: list[str] | None = None, max_len: int = 1000) -> DataFrame:
    """(host, pos, log): random sequences of a model of order k, from its start probabilities or from
    k given items; each ends at EOS, at an unknown state, or at max_len items."""
    table = _model(counts)
    if starts.limit(MODEL_ROWS + 1).count() > MODEL_ROWS:
        raise ValueError("too many starts to draw from on the driver")
    first = [(tuple(r["state"]), r["cnt"]) for r in starts.orderBy("state").collect()]
    rows = []
    for host in range(number if first or start else 0):
        items = list(start) if start else list(_draw(first, seed, host, 0))
        k = len(items)
        while len(items) < max_len and (now := tuple(items[-k:])) in table:
            nxt = _draw(table[now], seed, host, len(items))
            if nxt == EOS:
                break
            items.append(nxt)
        rows += [(host, i, x) for i, x in enumerate(items, 1)]
    return counts.sparkSession.createDataFrame(rows, "host int, pos int, log string")
