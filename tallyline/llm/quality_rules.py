"""Quality rules as weak supervision, in DataFrame expressions only.

Every rule votes good (1), bad (0) or abstains (NULL). Instead of asking a
document to pass all rules, a label model with one hidden class per document
(good or bad) estimates by expectation-maximisation how reliable each rule is,
from the agreement of the rules alone, and turns the votes of a document into
the posterior probability that it is good.

The votes are counted by pattern first. There are at most 3^rules patterns,
whatever the number of documents, so an EM step is one aggregation over a small
table and returns one row.

Defined results: a NULL or empty text has no words, all measures 0, fails the
base check and is not kept. Repeated rows and repeated ids are judged row by
row. An empty table gives an empty result; the model then keeps its starting
values. Extra columns of any name pass through :func:`keep_good`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import WORD_GAP, free_name, let
from tallyline.session import materialize

SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_capitals", "n_marks")


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""
    name: str
    bad: str
    good: str


#: Conditions over the measures of :func:`measures`.
RULES = (
    Rule("length", "n_words < 50", "n_words >= 100"),
    Rule("word_length", "word_chars < 3 * n_words OR word_chars > 12 * n_words",
         "word_chars BETWEEN 3.5 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    Rule("repeated_words", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("capitals", "10 * n_capitals > 3 * word_chars", "20 * n_capitals <= 3 * word_chars"),
    Rule("marks", "4 * n_marks > n_words", "20 * n_marks <= n_words"),
)


@dataclass
class LabelModel:
    """``good[j]``: probability that rule j, when it votes, votes good on a good
    document; ``bad[j]``: that it votes bad on a bad one."""
    prior: float
    good: list[float]
    bad: list[float]
    steps: int = 0
    rules: tuple[Rule, ...] = field(default=RULES)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), "")


def repeated_window_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that occurs at least twice in
    the text, the first occurrence included; each word counts once.

    Windows are compared by 64-bit hash. Sorting (hash, place) puts equal windows
    side by side, so the cost is n log n in the length of a text.
    """
    def covered(hashes: Column) -> Column:
        places = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twins = let(places, lambda p: F.filter(p, lambda x, k: (
            ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
            | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)))))
        starts = F.sort_array(F.transform(twins, lambda x: x["i"]))
        first = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(starts, first, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total["n"]).otherwise(0)

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return let(words, lambda w: F.when(F.size(w) >= width, let(windows(w), covered)).otherwise(0))


def measures(text: Column) -> Column:
    """A struct of BIGINT measures of one text (:data:`MEASURES`)."""
    whole = F.coalesce(text, F.lit(""))

    def count_of(pattern: str) -> Column:
        return F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))

    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
                        repeated_window_words(w).cast("bigint").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    def put(w: Column, x: Column) -> Column:
        return F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"),
                        count_of(SYMBOLS).cast("bigint").alias("n_symbols"),
                        x["n_dup_lines"].alias("n_dup_lines"),
                        w["n_repeat_words"].alias("n_repeat_words"),
                        x["n_lines"].alias("n_lines"),
                        count_of("\\p{Lu}+").cast("bigint").alias("n_capitals"),
                        count_of("[!?]+").cast("bigint").alias("n_marks"))

    return let(let(words_of(text), of_words), lambda w: let(let(lines, of_lines), lambda x: put(w, x)))


def base_failed(m: str) -> Column:
    return F.expr(f"{m}.n_words < 50 OR 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def _in_struct(condition: str, m: str) -> str:
    for name in sorted(MEASURES, key=len, reverse=True):
        condition = condition.replace(name, f"\0{MEASURES.index(name)}\0")
    for i, name in enumerate(MEASURES):
        condition = condition.replace(f"\0{i}\0", f"`{m}`.{name}")
    return condition


def votes(m: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """An array of 1 (good), 0 (bad) or NULL (abstains), one entry per rule,
    from the struct column ``m`` of measures."""
    return F.array(*[F.expr(f"CASE WHEN {_in_struct(r.bad, m)} THEN 0 "
                            f"WHEN {_in_struct(r.good, m)} THEN 1 END") for r in rules])


def measured(df: DataFrame, text_col: str = "text",
             rules: tuple[Rule, ...] = RULES, keep_text: bool = True) -> tuple[DataFrame, str, str]:
    """``df`` (without its text unless ``keep_text``) with the measures and the
    votes of each row, written once to the shared folder: the label model and its
    application both read them, and the texts are gone through once. Returns the
    frame and the two column names."""
    m = free_name(df, "measures")
    v = free_name(df, "votes")
    out = df.withColumn(m, measures(F.col(f"`{text_col}`")))
    if not keep_text:
        out = out.drop(text_col)
    return materialize(out.withColumn(v, votes(m, rules)), "quality-votes"), m, v


def _log_odds(v: str, model: LabelModel) -> Column:
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for j in range(len(model.rules)):
        vote = F.get(F.col(v), F.lit(j))
        total = total + F.when(vote == 1, math.log(model.good[j] / (1 - model.bad[j]))).when(
            vote == 0, math.log((1 - model.good[j]) / model.bad[j])).otherwise(0.0)
    return total


def posterior(v: str, model: LabelModel) -> Column:
    """Probability that a row with votes ``v`` is good."""
    return 1.0 / (1.0 + F.exp(-_log_odds(v, model)))


def fit(rows: DataFrame, v: str, rules: tuple[Rule, ...] = RULES, steps: int = 15,
        prior: float = 0.7, good: float = 0.9, bad: float = 0.4, weight: float = 20.0,
        tolerance: float = 1e-4, counted: bool = False) -> LabelModel:
    """Estimate the label model by expectation-maximisation over all rows, or over
    patterns with their counts ``n`` where ``counted``.

    Starts from ``prior``, ``good`` and ``bad``, which also act as ``weight``
    imagined votes per rule, so that a rule that hardly ever votes stays near its
    starting accuracy. Ends after ``steps`` or when nothing moves by more than
    ``tolerance``.
    """
    patterns = rows if counted else rows.groupBy(F.col(f"`{v}`").alias("votes")).agg(
        F.count(F.lit(1)).alias("n"))
    # at most 3^rules rows: in one sorted file, sums are taken in one order whatever the partitions
    table = materialize(patterns.repartition(1).sortWithinPartitions("votes"), "vote-patterns")
    v = "votes"
    model = LabelModel(prior, [good] * len(rules), [bad] * len(rules), 0, rules)
    for _ in range(steps):
        scored = table.withColumn("p", posterior(v, model))
        sums = [F.sum(F.col("n") * F.col("p")).alias("good_n"), F.sum("n").alias("n")]
        for j in range(len(rules)):
            vote = F.get(F.col(v), F.lit(j))
            up, down = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
            sums += [F.sum(F.when(vote == 1, up)).alias(f"gg{j}"),
                     F.sum(F.when(vote.isNotNull(), up)).alias(f"g{j}"),
                     F.sum(F.when(vote == 0, down)).alias(f"bb{j}"),
                     F.sum(F.when(vote.isNotNull(), down)).alias(f"b{j}")]
        got = scored.agg(*sums).first().asDict()
        if not got["n"]:
            break
        new_prior = (got["good_n"] + prior * weight) / (got["n"] + weight)
        new_good = [((got[f"gg{j}"] or 0) + good * weight) / ((got[f"g{j}"] or 0) + weight)
                    for j in range(len(rules))]
        new_bad = [((got[f"bb{j}"] or 0) + bad * weight) / ((got[f"b{j}"] or 0) + weight)
                   for j in range(len(rules))]
        moved = max(abs(a - b) for a, b in zip([new_prior, *new_good, *new_bad],
                                               [model.prior, *model.good, *model.bad]))
        model = LabelModel(new_prior, new_good, new_bad, model.steps + 1, rules)
        if moved < tolerance:
            break
    return model


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5) -> DataFrame:
    """Measures, posterior and verdict of each row of ``df``."""
    rows, m, v = measured(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")),
                         keep_text=False)
    model = fit(rows, v)
    p = posterior(v, model)
    return rows.select(
        "doc_id", *[F.col(f"{m}.{c}").alias(c) for c in MEASURES[:5]],
        base_failed(m).alias("base_failed"), p.alias("posterior"),
        (~base_failed(m) & (p >= threshold)).alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that pass the base check and whose posterior reaches
    ``threshold``, with the columns of ``df``."""
    rows, m, v = measured(df, text_col)
    model = fit(rows.select(v), v)
    kept = rows.where(~base_failed(f"`{m}`") & (posterior(v, model) >= threshold))
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])
