"""Quality rules as weak supervision: votes, estimated accuracies, posterior probability. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_text, materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
ROUNDS = 30
# What is known of the rules beforehand, as pseudo-counts: how often a rule that votes is for a good and for a bad
# document (almost always if it is good; if it is bad, often still, as there are many ways to be bad and a rule sees
# one), and the share of all documents that this knowledge weighs as much as. The estimates are free within (0, 1).
START, WEIGHT = (0.999, 0.7), (0.2, 0.02)


def _vote(bad: Column, good: Column) -> Column:
    """0 votes against the document, 1 for it, 2 abstains."""
    return F.when(bad, 0).when(good, 1).otherwise(2)


# Each rule sees the counts of one document. Thresholds are parameters of the rules, not of the data.
RULES: dict[str, Callable[[], Column]] = {
    "length": lambda: _vote(F.col("n_words") < 10, F.col("n_words") >= 30),
    "repeats": lambda: _vote(100 * F.col("n_repeat_words") > 20 * F.col("n_words"), 100 * F.col("n_repeat_words") <= 10 * F.col("n_words")),
    "lines": lambda: _vote(2 * F.col("n_dup_lines") > F.col("n_lines"), F.col("n_dup_lines") == 0),
    "symbols": lambda: _vote(10 * F.col("n_symbols") > 3 * F.col("n_words"), 100 * F.col("n_symbols") <= 5 * F.col("n_words")),
    "marks": lambda: _vote(4 * F.col("n_marks") > F.col("n_words"), 20 * F.col("n_marks") <= F.col("n_words")),
    "word_length": lambda: _vote((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
                                 (F.col("word_chars") >= 3 * F.col("n_words")) & (F.col("word_chars") <= 9 * F.col("n_words"))),
    "capitals": lambda: _vote(10 * F.col("n_capitals") > 4 * F.col("word_chars"), 10 * F.col("n_capitals") <= F.col("word_chars")),
    "shouting": lambda: _vote(10 * F.col("n_shouts") > 3 * F.col("n_words"), 100 * F.col("n_shouts") <= 5 * F.col("n_words")),
    "variety": lambda: _vote((F.col("n_words") >= 30) & (F.col("n_distinct") * F.col("n_distinct") < 4 * F.col("n_words")),
                             F.col("n_distinct") * F.col("n_distinct") >= 9 * F.col("n_words")),
}


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each row's whole text: ``_id`` and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines, n_marks, n_capitals, n_shouts, n_distinct (all long). One row in, one row out, no shuffle.

    Words in 5-word windows found twice or more are counted from sorted window hashes, and only where the
    windows are not all distinct."""
    t = id_text(docs, id_col, text_col).select("_id", F.coalesce("_text", F.lit("")).alias("_t"))
    t = t.select("_id", "_t", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)).alias("w"))
    t = t.select("_id", F.size("w").alias("n"), F.char_length(F.array_join("w", "")).alias("word_chars"),
                 F.regexp_count("_t", F.lit(SYMBOLS)).alias("n_symbols"), F.regexp_count("_t", F.lit(SYMBOLS + "+")).alias("n_marks"), F.regexp_count("_t", F.lit("[A-Z]")).alias("n_capitals"),
                 F.regexp_count("_t", F.lit("[!?]{2,}")).alias("n_shouts"),
                 F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    t = t.select("*", F.transform(F.slice("h", 1, F.greatest(F.col("n") - 4, F.lit(0))), lambda x, i: F.xxhash64(
        x, F.get("h", i + 1), F.get("h", i + 2), F.get("h", i + 3), F.get("h", i + 4))).alias("win"))
    t = t.select("*", F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(
        F.transform("win", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("s"))
    same = lambda i, x: F.coalesce(F.get("s", i)["h"] == x["h"], F.lit(False))
    t = t.select("*", F.sort_array(F.transform(F.filter("s", lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["p"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("at", i + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    num = lambda c: c.cast("long")
    return t.select("_id", num(F.col("n")).alias("n_words"), num(F.col("word_chars")).alias("word_chars"), num(F.col("n_symbols")).alias("n_symbols"),
                    num(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), num(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
                    num(F.size("lines")).alias("n_lines"), num(F.col("n_marks")).alias("n_marks"), num(F.col("n_capitals")).alias("n_capitals"), num(F.col("n_shouts")).alias("n_shouts"),
                    num(F.size(F.array_distinct("h"))).alias("n_distinct"))


def _log_odds(votes: Column, p: Column) -> Column:
    """Log odds of good from the votes: prior and, per rule that votes, the ratio of its rates in both classes."""
    return F.log(p["prior"] / (1 - p["prior"])) + F.aggregate(
        F.zip_with(votes, p["rate"], lambda v, r: F.when(v == 1, F.log(r["good"] / r["bad"]))
                   .when(v == 0, F.log((1 - r["good"]) / (1 - r["bad"]))).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


def _posterior(votes: Column, p: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes, p)))


def estimate(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row ``p``: the share of good documents and, per rule, how often it votes for a document when it
    votes, among good and among bad ones. Expectation-maximisation over the counts of vote patterns
    (``votes`` array, ``c``), at most 3 ** n_rules rows, as a fold over the rounds. The rates start at ``START``, which
    also counts like ``WEIGHT`` of all documents in every round (a Beta prior); nothing is clamped."""
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("c").cast("double").alias("c")))).alias("x"))
    start = F.struct(F.lit(0.85).alias("prior"), F.array(*[F.struct(F.lit(START[0]).alias("good"), F.lit(START[1]).alias("bad"))] * n_rules).alias("rate"))
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))

    def step(p: Column, _: Column) -> Column:
        # a transform over a one-element array names the posteriors, so they are computed once a round
        post = F.array(F.transform("x", lambda x: F.struct(x["votes"].alias("votes"), (x["c"] * _posterior(x["votes"], p)).alias("g"), x["c"].alias("c"))))

        def rates(q: Column) -> Column:
            every = total(q, lambda x: x["c"]) + 1

            def rate(j: int) -> Column:
                up = lambda x, m: F.when(x["votes"][j] == 1, m).otherwise(0.0)
                on = lambda x, m: F.when(x["votes"][j] < 2, m).otherwise(0.0)
                good, bad = (lambda x: x["g"]), (lambda x: x["c"] - x["g"])
                share = lambda m, k: (total(q, lambda x: up(x, m(x))) + WEIGHT[k] * every * START[k]) / (total(q, lambda x: on(x, m(x))) + WEIGHT[k] * every)
                return F.struct(share(good, 0).alias("good"), share(bad, 1).alias("bad"))
            prior = (total(q, lambda x: x["g"]) + 1.7) / (every + 1)
            return F.struct(prior.alias("prior"), F.array(*[rate(j) for j in range(n_rules)]).alias("rate"))
        return F.transform(post, rates)[0]

    return one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("p"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: dict | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) for
    every row of ``docs``.

    ``base_failed``: fewer than 10 words, or more than 20 % of the words in repeated 5-word windows. Rules
    vote for or against a document or abstain; expectation-maximisation over all documents estimates the
    rules' rates among good and bad ones; ``probability`` is the posterior that the document is good, and
    ``kept`` is true where the base did not fail and it is at least one half.

    The counts are written once; votes are aggregated to at most 3 ** (number of rules) patterns, which is
    the bound of what is broadcast. All of it are DataFrame functions.

    A null or empty text has no words (base_failed, not kept). A null id stays null; repeated rows get a
    row each; other columns are ignored; an empty table gives an empty table."""
    rules = rules or RULES
    base = materialize(counts(docs, id_col, text_col), "quality-counts").withColumn("votes", F.array(*[r() for r in rules.values()]))
    patterns = materialize(base.groupBy("votes").agg(F.count("*").alias("c")), "quality-patterns")
    params = materialize(estimate(patterns, len(rules), rounds), "quality-rates")
    judged = (patterns.select("votes", params.scalar().alias("p"))  # one row: a scalar subquery
              .select("votes", _posterior(F.col("votes"), F.col("p")).alias("probability")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (base.join(F.broadcast(judged), "votes", "left")
            .select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & (F.col("probability") >= 0.5)).alias("kept"), "probability"))
