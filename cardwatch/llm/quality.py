"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

DataFrame functions only; the estimation works on counts of vote patterns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cardwatch.llm.shared import stage

#: Frequent function words of the languages served; fixed values.
STOP_WORDS = (
    "the of and to in is that it for with as on be by this was are "
    "de la el que en los las un una por con para se del al su es "
    "le les des et un une du dans que qui est pour pas sur au "
    "der die das und ist von zu mit den ein eine im auf nicht für sich dem"
).split()

GOOD, BAD, SILENT = "2", "0", "1"


def measured(docs: DataFrame, *, text_col: str = "text", out: str = "quality") -> DataFrame:
    """Appends one struct of measures of the whole text; a column named `out` is replaced.

    Words are runs of other characters than space and \\t to \\r. Null text: no words.
    Repeated words are those inside a window of five words found twice or more in the
    text: windows are sorted within the row, and only where some repeat.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select(
        *kept,
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(text).alias("_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).alias("_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("_upper"),
        F.regexp_count(text, F.lit("!!")).alias("_shouts"),
        F.regexp_count(text, F.lit("[.!?…](?=[\\x20\\x09-\\x0D]|$)")).alias("_sentences"),
    )
    windows = F.expr(
        "if(size(_words) < 5, cast(array() as array<string>), transform(sequence(0, size(_words) - 5),"
        " i -> concat_ws(' ', _words[i], _words[i + 1], _words[i + 2], _words[i + 3], _words[i + 4])))"
    )
    base = base.withColumn("_windows", windows)
    in_order = F.expr(
        "if(size(array_distinct(_windows)) = size(_windows),"
        " cast(array() as array<struct<w: string, i: int>>),"
        " sort_array(transform(_windows, (x, i) -> named_struct('w', x, 'i', i))))"
    )
    base = base.withColumn("_order", in_order)
    starts = F.expr(
        "array_sort(filter(transform(_order, (x, i) -> if("
        " (i > 0 and _order[greatest(i - 1, 0)].w = x.w)"
        " or (i < size(_order) - 1 and _order[least(i + 1, size(_order) - 1)].w = x.w),"
        " x.i, null)), x -> x is not null))"
    )
    base = base.withColumn("_starts", starts)
    covered = F.expr(
        "aggregate(_starts, named_struct('last', -5, 'n', 0L), (a, x) ->"
        " named_struct('last', x, 'n', a.n + least(5, x - a.last)), a -> a.n)"
    )
    stops = F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS)))
    measures = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.col("_chars").cast("long").alias("n_chars"),
        F.col("_upper").cast("long").alias("n_upper"),
        F.col("_shouts").cast("long").alias("n_shouts"),
        F.col("_sentences").cast("long").alias("n_sentences"),
        stops.cast("long").alias("n_stop_words"),
    )
    # A generator keeps later filters on the measures above it, so that they read them
    # instead of repeating their expressions.
    return base.select(*kept, F.explode(F.array(measures)).alias(out))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(SILENT)


def rules(out: str = "quality") -> dict[str, Column]:
    """Votes from the measures: bad, good or silent. A text without words is silent to
    all rules but the first."""
    m = {c: F.col(f"`{out}`.{c}") for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_chars", "n_upper", "n_shouts", "n_sentences", "n_stop_words",
    )}
    n = m["n_words"]
    mean = F.try_divide(m["word_chars"], n)
    never = F.lit(False)
    return {
        "length": _vote(n < 10, never),
        "word_length": _vote((mean < 2.5) | (mean > 12), mean.between(3, 9)),
        "symbols": _vote(m["n_symbols"] * 12 > n, never),
        "dup_lines": _vote(m["n_dup_lines"] * 10 >= m["n_lines"] * 3, never),
        "repeats": _vote(m["n_repeat_words"] * 5 > n, never),
        "capitals": _vote(m["n_upper"] * 4 > m["n_chars"], never),
        "shouting": _vote(m["n_shouts"] * 20 > n, never),
        "sentences": _vote(m["n_sentences"] * 100 < n, m["n_sentences"] * 60 >= n),
        "stop_words": _vote(m["n_stop_words"] * 100 < n * 4, m["n_stop_words"] * 100 >= n * 10),
    }


#: Where estimation starts: how often a rule votes about a good and about a bad document.
START = {GOOD: {GOOD: 0.7, SILENT: 0.28, BAD: 0.02}, BAD: {GOOD: 0.3, SILENT: 0.3, BAD: 0.4}}


@dataclass(frozen=True)
class VoteModel:
    """The share of good documents, and rates[truth][rule][vote]."""

    prior: float
    rates: dict[str, list[dict[str, float]]]

    def accuracies(self) -> list[float]:
        """For each rule, how often a vote is right where it votes."""
        found = []
        for good, bad in zip(self.rates[GOOD], self.rates[BAD], strict=True):
            right = self.prior * good[GOOD] + (1 - self.prior) * bad[BAD]
            wrong = self.prior * good[BAD] + (1 - self.prior) * bad[GOOD]
            found.append(right / (right + wrong))
        return found

    def weights(self) -> list[dict[str, float]]:
        """Log odds for good that each vote, or silence, adds."""
        return [
            {v: math.log(good[v] / bad[v]) for v in good}
            for good, bad in zip(self.rates[GOOD], self.rates[BAD], strict=True)
        ]

    def probability(self, votes: dict[str, Column]) -> Column:
        """Posterior probability that a document is good."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for w, vote in zip(self.weights(), votes.values(), strict=True):
            added = F.when(vote == GOOD, w[GOOD]).when(vote == BAD, w[BAD]).otherwise(w[SILENT])
            total = total + added
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _held(good: dict[str, float], bad: dict[str, float]) -> None:
    """A vote never speaks for its opposite: where rates say so, they become equal."""
    for vote, more, less in ((GOOD, good, bad), (BAD, bad, good)):
        if more[vote] < less[vote]:
            more[vote] = less[vote] = (more[vote] + less[vote]) / 2


def fit(rows: DataFrame, votes: dict[str, Column], *, rounds: int = 60) -> VoteModel:
    """Expectation-maximisation on the counts of vote patterns of all rows.

    There are at most 3 ** rules patterns, whatever the number of rows. START counts as
    ten documents of either kind. No rows: the start.
    """
    counts = rows.groupBy(F.concat(*votes.values()).alias("votes")).count().collect()
    patterns = {r["votes"]: r["count"] for r in counts}
    total = sum(patterns.values())
    model = VoteModel(0.8, {y: [dict(START[y]) for _ in votes] for y in START})
    for _ in range(rounds):
        weights = model.weights()
        seen = {y: [{v: 10 * p for v, p in START[y].items()} for _ in votes] for y in START}
        base, good = math.log(model.prior / (1 - model.prior)), 8.0
        for pattern, n in patterns.items():
            odds = base + sum(w[v] for w, v in zip(weights, pattern, strict=True))
            p = 1 / (1 + math.exp(-odds))
            good += n * p
            for j, v in enumerate(pattern):
                seen[GOOD][j][v] += n * p
                seen[BAD][j][v] += n * (1 - p)
        rates = {
            y: [{v: k / sum(c.values()) for v, k in c.items()} for c in seen[y]] for y in seen
        }
        for pair in zip(rates[GOOD], rates[BAD], strict=True):
            _held(*pair)
        model = VoteModel(min(max(good / (10 + total), 0.01), 0.99), rates)
    return model


def base_failed(out: str = "quality") -> Column:
    n = F.col(f"`{out}`.n_words")
    return (n < 10) | (100 * F.col(f"`{out}`.n_repeat_words") > 20 * n)


def kept(model: VoteModel, out: str = "quality", threshold: float = 0.5) -> Column:
    """False where the base rules fail; else whether the document is more likely good."""
    return ~base_failed(out) & (model.probability(rules(out)) >= threshold)


def judge(
    docs: DataFrame, *, text_col: str = "text", out: str = "quality", threshold: float = 0.5
) -> DataFrame:
    """All rows with their measures, the posterior probability and the verdict.

    Appends `out`, `quality_probability`, `base_failed` and `kept` (like-named columns are
    replaced) and leaves the text out. Measures are written once to the shared folder, so
    pass only the columns that you need; see `filter_good` for whole rows.

    Null and empty text: no words, so base_failed. Very long texts are measured whole.
    Ties and repeated rows are judged alike, each by itself. Empty table: no rows.
    """
    names = ("quality_probability", "base_failed", "kept")
    docs = docs.drop(*names)
    rows = measured(docs, text_col=text_col, out=out).drop(text_col)
    rows = stage(rows, "quality")
    votes = rules(out)
    model = fit(rows, votes)
    return rows.withColumns(
        {
            "quality_probability": model.probability(votes),
            "base_failed": base_failed(out),
            "kept": kept(model, out, threshold),
        }
    )


def filter_good(
    docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """The rows that `judge` keeps, with their own columns.

    Texts are measured twice, for the model and for the verdict: that moves no text, which
    joining verdicts to texts would.
    """
    out = "_quality"
    while out in docs.columns:
        out = f"_{out}"
    model = fit(measured(docs.select(text_col), text_col=text_col, out=out), rules(out))
    rows = measured(docs, text_col=text_col, out=out)
    return rows.filter(kept(model, out, threshold)).drop(out)
