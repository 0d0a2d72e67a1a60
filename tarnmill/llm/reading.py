"""Reading level of each document: ordinal regression over text features, fitted to graded text.

Features are computed in one pass of built-in functions over whole texts. Word rarity comes from
exact counts of all words of all documents; their table is sent to all executors only if its counted
size allows that, and joined by a shuffle otherwise. Features are standardised within each language over
all its documents. The regression (proportional odds, ridge penalty) is fitted on at most `max_labels`
label rows, the lowest by hash; at that bound the fit no longer changes noticeably.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import small, spread, stage

FEATURES = ("sentence", "word", "long", "connective", "clause", "diversity", "rarity", "size")
#: Words that join or subordinate clauses (fixed values, plain everyday words of the three languages).
CONNECTIVES = (
    "and or but because although though while whereas whereby wherein where which that when if unless since so thus therefore however moreover such "
    "und oder aber weil obwohl während wobei wodurch worin welche welcher welches dass sodass wenn falls da also daher jedoch indem damit "
    "et ou mais car parce quoique bien tandis lequel laquelle dont où que qui quand lorsque si donc ainsi cependant afin alors tel telle"
).split()
_WORD = r"\p{L}+(?:[-'’]\p{L}+)*"


def plain_lang(lang: Column) -> Column:
    return F.lower(F.trim(lang))


def _words(docs: DataFrame) -> DataFrame:
    return docs.withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))


def word_rarities(docs: DataFrame) -> DataFrame:
    """(lang, w, rarity): minus the log of the share that the word has of all words of (lang, text).
    Marked for broadcast only if its counted size allows that."""
    # An inner explode would make Spark find all words twice, once for a filter on empty lists.
    words = _words(docs).select("lang", F.explode_outer("words").alias("w")).where("w is not null")
    counts = stage(words.groupBy("lang", "w").agg(F.count("*").alias("n")), "word-counts")
    total, rows, size = counts.agg(F.sum("n"), F.count("*"), F.sum(F.octet_length("w"))).first()
    rarities = counts.select("lang", "w", (F.log(F.lit(float(total or 1))) - F.log(F.col("n").cast("double"))).alias("rarity"))
    return small(rarities, rows, 64 + (size or 0) // max(rows, 1))


def text_features(docs: DataFrame, rarities: DataFrame) -> DataFrame:
    """(row, doc_id, lang, *FEATURES) of (doc_id, lang, text) with non-blank text; one row for each
    row of docs. A text without words has zeros."""
    sentences = F.greatest(F.regexp_count("text", F.lit(r"[.!?。！？](?=\s|$)")), F.lit(1))
    commas = F.length("text") - F.length(F.replace(F.col("text"), F.lit(",")))
    rows = (
        _words(docs.withColumn("row", F.monotonically_increasing_id()).withColumn("sentences", sentences).withColumn("commas", commas))
        .withColumn("different", F.size(F.array_distinct("words")))
        .select("row", "doc_id", "lang", "sentences", "commas", "different", F.explode_outer("words").alias("w"))
    )
    joined = rows.join(rarities, ["lang", "w"], "left")
    n = F.greatest(F.col("n"), F.lit(1)).cast("double")
    sums = joined.groupBy("row", "doc_id", "lang", "sentences", "commas", "different").agg(
        F.count("w").alias("n"),
        F.sum(F.length("w")).alias("letters"),
        F.count(F.when(F.length("w") >= 12, 1)).alias("long"),
        F.count(F.when(F.col("w").isin(CONNECTIVES), 1)).alias("links"),
        F.sum(F.when(F.col("w").isNotNull(), F.coalesce("rarity", F.lit(0.0)))).alias("rare"),
    )
    return sums.select(
        "row",
        "doc_id",
        "lang",
        F.log((F.col("n") + 1) / F.col("sentences")).alias("sentence"),
        (F.coalesce("letters", F.lit(0)) / n).alias("word"),
        (F.col("long") / n).alias("long"),
        (F.col("links") / n).alias("connective"),
        F.log((F.col("commas") + F.col("links") + 1) / F.col("sentences")).alias("clause"),
        (F.col("different") / F.sqrt(n)).alias("diversity"),
        (F.coalesce("rare", F.lit(0.0)) / n).alias("rarity"),
        F.log(n).alias("size"),
    )


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(cuts[k] - beta . x)."""

    beta: np.ndarray
    cuts: np.ndarray

    def grade(self, x: np.ndarray) -> np.ndarray:
        return 1 + (x @ self.beta[:, None] > self.cuts[None, :]).sum(axis=1)


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int = 5, ridge: float = 0.1, rounds: int = 60) -> OrdinalModel:
    """Proportional odds with a ridge penalty on beta, by damped Newton steps (the penalised
    likelihood is concave). y holds 1..grades; a grade without labels gets an empty interval's worth
    of room from the penalty on the cuts' distance from their start."""
    n, k = x.shape
    share = np.cumsum(np.bincount(y, minlength=grades + 1)[1:grades] + 0.5) / (n + 0.5 * grades)
    start = np.log(share / (1 - share))
    p = np.concatenate([np.zeros(k), start])

    def parts(p):
        eta = x @ p[:k]
        cuts = np.concatenate([[-np.inf], p[k:], [np.inf]])
        if np.any(np.diff(p[k:]) <= 0):
            return None
        fa, fb = 1 / (1 + np.exp(-(cuts[y] - eta))), 1 / (1 + np.exp(-(cuts[y - 1] - eta)))
        pr = np.maximum(fa - fb, 1e-12)
        loss = -np.log(pr).sum() + ridge * (p[:k] @ p[:k]) / 2 * max(n, 1) / 100 + 0.05 * ((p[k:] - start) ** 2).sum() / 2
        return fa, fb, pr, loss

    with np.errstate(over="ignore"):
        now = parts(p)
        for _ in range(rounds):
            fa, fb, pr, loss = now
            ga, gb = fa * (1 - fa), fb * (1 - fb)
            up, low = np.zeros((n, grades - 1)), np.zeros((n, grades - 1))
            rows = np.arange(n)
            m = y < grades
            up[rows[m], y[m] - 1] = 1
            m = y > 1
            low[rows[m], y[m] - 2] = 1
            da, db = ga / pr, -gb / pr
            grad = np.concatenate([x.T @ (fa + fb - 1), up.T @ da + low.T @ db])
            haa = (ga * (1 - 2 * fa) * pr - ga**2) / pr**2
            hbb = -(gb * (1 - 2 * fb) * pr + gb**2) / pr**2
            hab = ga * gb / pr**2
            h = np.zeros((k + grades - 1,) * 2)
            h[:k, :k] = -(x.T * (ga + gb)) @ x
            h[:k, k:] = x.T @ (up * ga[:, None] + low * gb[:, None])
            h[k:, :k] = h[:k, k:].T
            h[k:, k:] = (up.T * haa) @ up + (low.T * hbb) @ low + (up.T * hab) @ low + (low.T * hab) @ up
            grad[:k] -= ridge * max(n, 1) / 100 * p[:k]
            grad[k:] -= 0.05 * (p[k:] - start)
            h[:k, :k] -= ridge * max(n, 1) / 100 * np.eye(k)
            h[k:, k:] -= 0.05 * np.eye(grades - 1)
            step = np.linalg.solve(h - 1e-9 * np.eye(len(p)), -grad)
            size = 1.0
            while size > 1e-8:
                new = parts(p + size * step)
                if new is not None and new[3] <= loss:
                    break
                size /= 2
            else:
                break
            p, now = p + size * step, new
            if loss - now[3] < 1e-9 * (1 + abs(loss)):
                break
    return OrdinalModel(p[:k], p[k:])


def reading_levels(
    docs: DataFrame, labels: DataFrame, langs: tuple[str, ...] = ("en", "de", "fr"), max_labels: int = 20_000, ridge: float = 0.1, seed: int = 7
) -> DataFrame:
    """(doc_id, lang, score, grade) of the documents with non-blank text in one of `langs`.

    Every label row with a grade from 1 to 5 counts, several raters of a document each for
    themselves. Null and blank texts, and other languages, give no row; documents without label get
    a grade like all others. Without any label there is nothing to fit and the grade is null.
    """
    wanted = docs.select("doc_id", plain_lang(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(*langs) & F.col("text").rlike(r"[^\s\p{Z}]"))
    wanted = spread(wanted)
    feats = stage(text_features(wanted, word_rarities(wanted)), "reading-features")
    stats = {r["lang"]: r for r in feats.groupBy("lang").agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).collect()}

    def z(c: str) -> Column:
        out = F.lit(0.0)
        for lang, r in stats.items():
            if r[f"s_{c}"]:
                out = F.when(F.col("lang") == lang, (F.col(c) - F.lit(r[f"m_{c}"])) / F.lit(r[f"s_{c}"])).otherwise(out)
        return out

    scaled = feats.select("doc_id", "lang", *[z(c).alias(c) for c in FEATURES])
    graded = labels.where("doc_id is not null and grade between 1 and 5").select("doc_id", "grade", F.xxhash64(F.lit(seed), "doc_id", "rater").alias("h"))
    sample = graded.orderBy("h", "doc_id", "grade").limit(max_labels)
    rows = scaled.join(F.broadcast(sample), "doc_id").select(*FEATURES, "grade").collect()
    if not rows:
        return scaled.select("doc_id", "lang", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("grade"))
    data = np.array([[float(v) for v in r] for r in sorted(rows)])
    model = fit_ordinal(data[:, :-1], data[:, -1].astype(int), ridge=ridge)
    score = sum((F.col(c) * F.lit(float(b)) for c, b in zip(FEATURES, model.beta)), F.lit(0.0))
    grade = sum(((F.col("score") > F.lit(float(cut))).cast("int") for cut in model.cuts), F.lit(1))
    return scaled.select("doc_id", "lang", score.alias("score")).withColumn("grade", grade.cast("int"))
