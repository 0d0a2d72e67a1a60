"""Sequence models over event sequences, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markov
from ..sources.tables import table
from ..staging import staging_dir
from ..streaming import transitions
from .base import SEQ, r6
from .base import sequences as seq_of


def _joined(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.concat_ws("|", "state").alias("state"), *cols)


def markov_counts(spark: SparkSession, d: str) -> DataFrame:
    return markov.transition_counts(seq_of(spark, d))


def markov_probs(spark: SparkSession, d: str) -> DataFrame:
    return markov.probabilities(markov_counts(spark, d)).select("state", "next", "cnt", r6("prob"))


def markov_extend(spark: SparkSession, d: str) -> DataFrame:
    """Users below 70, then the others, whose counts must add up."""
    seq = seq_of(spark, d)
    both = markov.extend(markov.transition_counts(seq.where("host < 70")), markov.transition_counts(seq.where("host >= 70")))
    return markov.probabilities(both).select("state", "next", "cnt", r6("prob"))


def subsequent_probability(spark: SparkSession, d: str) -> DataFrame:
    return markov.subsequent_probability(markov.probabilities(markov_counts(spark, d)), "click").select("next", r6("prob"))


def sequence_probability(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    return markov.sequence_probability(seq, markov.probabilities(markov.transition_counts(seq))).select("host", "steps", r6("log_prob"))


def stationary_distribution(spark: SparkSession, d: str) -> DataFrame:
    return markov.stationary_distribution(markov_counts(spark, d)).select("state", r6("prob"))


def markov_generate(spark: SparkSession, d: str) -> DataFrame:
    return markov.generate(markov_counts(spark, d), 5, seed=11)


def order2_probs(spark: SparkSession, d: str) -> DataFrame:
    return _joined(markov.probabilities(markov.order_counts(seq_of(spark, d), 2)), "next", "cnt", r6("prob"))


def order3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _joined(markov.order_counts(seq_of(spark, d), 3), "next", "cnt")


def order2_extend(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    both = markov.extend(markov.order_counts(seq.where("host < 70"), 2), markov.order_counts(seq.where("host >= 70"), 2))
    return _joined(both, "next", "cnt")


def start_probs(spark: SparkSession, d: str) -> DataFrame:
    return _joined(markov.start_probabilities(seq_of(spark, d), 2), "cnt", r6("prob"))


def order2_sequence_probability(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    probs = markov.probabilities(markov.order_counts(seq, 2))
    return markov.order_sequence_probability(seq, probs, markov.start_probabilities(seq, 2), 2).select("host", r6("log_prob"))


def generate_by_steps(spark: SparkSession, d: str) -> DataFrame:
    """As markov_generate, step by step for all sequences at once."""
    return markov.generate_by_steps(markov_counts(spark, d), 5, seed=11, max_len=12)


def sequence_steps(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    return markov.sequence_steps(seq, markov.probabilities(markov.transition_counts(seq))).select("host", "step", r6("prob"))


def order2_steps(spark: SparkSession, d: str) -> DataFrame:
    """Without the probability of the start."""
    seq = seq_of(spark, d)
    return markov.order_sequence_steps(seq, markov.probabilities(markov.order_counts(seq, 2)), None, 2).select("host", "step", r6("prob"))


def starts_extend(spark: SparkSession, d: str) -> DataFrame:
    """Starts of the users below 70, extended by those of the others."""
    seq = seq_of(spark, d)
    both = markov.extend(markov.start_counts(seq.where("host < 70"), 2), markov.start_counts(seq.where("host >= 70"), 2))
    return _joined(markov.start_shares(both), "cnt", r6("prob"))


def order2_generate(spark: SparkSession, d: str) -> DataFrame:
    seq = seq_of(spark, d)
    return markov.generate_order(markov.order_counts(seq, 2), markov.start_probabilities(seq, 2), 5, seed=11)


def stream_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream, taken up to now; counts of pairs within and across micro-batches."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    pairs = transitions.transition_pairs(stream, "user_id", "ts", "event_id", "event_type")
    folder = f"{staging_dir(spark)}/tarnmill/stream-{uuid.uuid4().hex}"
    transitions.stream_counts(pairs, f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return transitions.read_counts(spark, f"{folder}/counts")


def queries() -> dict:
    names = (
        "markov_counts markov_probs markov_extend subsequent_probability sequence_probability stationary_distribution markov_generate "
        "generate_by_steps sequence_steps order2_steps starts_extend order2_generate stream_transitions order2_probs order3_counts order2_extend start_probs order2_sequence_probability"
    ).split()
    return {n: globals()[n] for n in names}


_M = f"""with {SEQ}, p as (select log as state, coalesce(lead(log) over (partition by host order by pos), '<EOS>') as next, host from seq
    union all select '<SOS>', log, host from seq where pos = 1),
c as (select state, next, count(*) as cnt from p group by all),
q as (select *, cnt / (sum(cnt) over (partition by state))::double as prob from c)
"""
_O = f"""with {SEQ}, f as (select host, pos, log as a, lead(log) over w as b, lead(log, 2) over w as c, lead(log, 3) over w as e from seq window w as (partition by host order by pos)),
o2 as (select host, pos, a || '|' || b as state, coalesce(c, '<EOS>') as next from f where b is not null),
c2 as (select state, next, count(*) as cnt from o2 group by all),
q2 as (select *, cnt / (sum(cnt) over (partition by state))::double as prob from c2),
s2 as (select state, count(*) as cnt, count(*) / (sum(count(*)) over ())::double as prob from o2 where pos = 1 group by state)
"""


_U = "('0x' || substr(md5('11|' || {} || '|' || {}), 1, 15))::bigint"


def _generated(most: int) -> str:
    u = _U.format("host", "pos")
    return _M.replace("with ", "with recursive ", 1) + f""", r as (select state, next, sum(cnt) over w as high, sum(cnt) over w - cnt as low, sum(cnt) over (partition by state) as total from c window w as (partition by state order by next rows unbounded preceding)),
        g as (select h::int as host, 0 as pos, '<SOS>' as log from (select unnest(range(5)) as h)
              union all select host, pos + 1, next from g join r on g.log = r.state and {u} % total >= low and {u} % total < high and next <> '<EOS>' where pos < {most})
        select host, pos, log from g where pos > 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "markov_counts": _M + "select * from c",
        "stream_transitions": _M + "select * from c where next <> '<EOS>'",
        "markov_probs": _M + "select state, next, cnt, round(prob, 6) as prob from q",
        "markov_extend": _M + "select state, next, cnt, round(prob, 6) as prob from q",
        "subsequent_probability": _M + "select next, round(prob, 6) as prob from q where state = 'click'",
        "sequence_probability": _M + "select host, count(*) as steps, round(sum(ln(prob)), 6) as log_prob from p join q using (state, next) group by host",
        "stationary_distribution": _M.replace("with ", "with recursive ", 1) + """, s as (select distinct state from c where state <> '<SOS>'),
            m as (select state, next, prob from q where state <> '<SOS>' and next <> '<EOS>'),
            v as (select state, 1.0::double / (select count(*) from s) as prob, 0 as i from s
                  union all select state, prob / sum(prob) over () as prob, i from (select m.next as state, sum(v.prob * m.prob) as prob, v.i + 1 as i from v join m on v.state = m.state where v.i < 60 group by m.next, v.i))
            select state, round(prob, 6) as prob from v where i = 60""",
        "markov_generate": _generated(1000),
        "generate_by_steps": _generated(12),
        "sequence_steps": f"""with {SEQ}, p as (select host, pos::int as step, log as state, coalesce(lead(log) over (partition by host order by pos), '<EOS>') as next from seq union all select host, 0, '<SOS>', log from seq where pos = 1),
            q as (select state, next, count(*) / (sum(count(*)) over (partition by state))::double as prob from p group by state, next)
            select host, step, round(prob, 6) as prob from p join q using (state, next)""",
        "order2_steps": _O + "select host, pos::int as step, round(prob, 6) as prob from o2 join q2 using (state, next)",
        "starts_extend": _O + "select state, cnt, round(prob, 6) as prob from s2",
        "order2_generate": _O.replace("with ", "with recursive ", 1) + f""", r2 as (select state, next, sum(cnt) over w as high, sum(cnt) over w - cnt as low, sum(cnt) over (partition by state) as total from c2 window w as (partition by state order by next rows unbounded preceding)),
            f2 as (select state, sum(cnt) over w as high, sum(cnt) over w - cnt as low, sum(cnt) over () as total from s2 window w as (order by state rows unbounded preceding)),
            g as (select h::int as host, 2 as pos, state from (select unnest(range(5)) as h) join f2 on {_U.format('h', '0')} % total >= low and {_U.format('h', '0')} % total < high
                  union all select host, pos + 1, split_part(g.state, '|', 2) || '|' || next from g join r2 on g.state = r2.state and {_U.format('host', 'pos')} % total >= low and {_U.format('host', 'pos')} % total < high and next <> '<EOS>' where pos < 1000)
            select host, 1 as pos, split_part(state, '|', 1) as log from g where pos = 2 union all select host, pos, split_part(state, '|', 2) from g""",
        "order2_probs": _O + "select state, next, cnt, round(prob, 6) as prob from q2",
        "order3_counts": _O + "select a || '|' || b || '|' || c as state, coalesce(e, '<EOS>') as next, count(*) as cnt from f where c is not null group by all",
        "order2_extend": _O + "select * from c2",
        "start_probs": _O + "select state, cnt, round(prob, 6) as prob from s2",
        "order2_sequence_probability": _O + """, y as (select host, s2.prob from o2 left join s2 using (state) where pos = 1 union all select host, q2.prob from o2 left join q2 using (state, next))
            select host, round(case when count(*) = count(prob) then sum(ln(prob)) end, 6) as log_prob from y group by host""",
    }
