"""Quality rules: a decision list learned from labelled statistics, as one Spark conditional expression.

All statistics are Spark expressions of the text. Sequential covering grows conjunctions of
thresholds, one after another: a rule starts empty, takes the threshold test that raises FOIL's
gain for bad documents most, until it covers no good one of the growing half or nothing gains; then
tests are dropped from its end while that doesn't lower (bad - good) / (bad + good) on the pruning
half. A rule joins the list if on all labelled rows its Laplace estimate of being right is at least
``precision``; the rows it covers leave. What no rule covers is kept, so the list errs towards keeping.

The labelled rows that are fitted are bounded (``max_rows``, those with the smallest hash of doc_id);
the list is applied to every document.

Defined results: null, empty and word-less texts have all statistics 0 and fail the base rule (fewer
than 20 words); with no labelled rows, or of one kind only, the list is empty and the base rule alone
decides; a doc_id with several labels counts with each, and one with several rows once for each label,
with the smallest statistics; of tests that gain equally the first feature and the smallest threshold is
taken; texts of any length are read whole; repeated rows come out once each; extra columns, whatever
their names, don't matter to statistics(); an empty table gives no rows. Labelled doc_ids must be numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows that are fitted, at most.
MAX_ROWS = 20_000
PRECISION = 0.9
MAX_RULES, MAX_TESTS, CUTS = 12, 4, 64


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, then n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), and what features() needs."""
    text = text_of()
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    # Where each window of words stands, by its hash; a window found twice is next to itself once sorted.
    n = REPEAT_WINDOW
    # (slice() copies the whole array each time; single elements are read in place.)
    windows = F.expr(f"transform(sequence(0, size(_words) - {n}), i -> xxhash64({', '.join(f'get(_words, i + {k})' for k in range(n))}))")
    hashes = F.when(F.size("_words") > n, windows).otherwise(F.array().cast("array<bigint>"))
    rows = docs.select(*[F.col(k) for k in keep], text.alias("_text")).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", lines).withColumn("_windows", hashes)
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.expr("array_sort(transform(_windows, (h, i) -> struct(h as h, i as i)))")))
    again = "filter(transform(_sorted, (x, j) -> if(get(_sorted, j - 1).h <=> x.h or get(_sorted, j + 1).h <=> x.h, x.i, null)), x -> x is not null)"
    rows = rows.withColumn("_places", F.expr(f"array_sort({again})"))
    covered = F.expr(f"aggregate(_places, struct(0L as n, 0 as reach), (a, p) -> struct(a.n + {n} - greatest(0, a.reach - p) as n, p + {n} as reach), a -> a.n)")
    symbols = F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", ""))
    upper = F.length(F.regexp_replace("_text", "[^\\p{Lu}]+", ""))
    stops = F.length(F.regexp_replace("_text", "[^.,;:!?]+", ""))
    digits = F.length(F.regexp_replace("_text", "[^0-9]+", ""))
    found = F.struct(
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        upper.cast("long").alias("n_upper"),
        stops.cast("long").alias("n_stops"),
        digits.cast("long").alias("n_digits"),
    )
    # As a generator's output: Catalyst moves no filter on a statistic, with copies of its whole
    # expression, below the steps that compute each of them once.
    return rows.select(*[F.col(k) for k in keep], F.inline(F.array(found)))


def _share(top: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(top) / F.col(of)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may test, over the columns of statistics()."""
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbols": _share("n_symbols", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeat_words": _share("n_repeat_words", "n_words"),
        "distinct": _share("n_distinct", "n_words"),
        "upper": _share("n_upper", "word_chars"),
        "stops": _share("n_stops", "n_words"),
        "digits": _share("n_digits", "word_chars"),
        "line_words": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    value: float

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value

    def column(self) -> Column:
        c = features()[self.feature]
        return c >= self.value if self.at_least else c < self.value


Rule = tuple[Test, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for test in rule:
        out &= test.rows(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    at = np.ones(len(bad), bool)
    while len(rule) < MAX_TESTS and (~bad[at]).any() and bad[at].any():
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        best, gain = None, 1e-9
        for name, v in x.items():
            inside = v[at]
            cuts = np.unique(np.quantile(inside, np.linspace(0, 1, CUTS + 1)[1:-1]))
            order = np.sort(inside[bad[at]]), np.sort(inside[~bad[at]])
            below = [np.searchsorted(o, cuts) for o in order]
            for at_least in (False, True):
                p1, n1 = (len(o) - b if at_least else b for o, b in zip(order, below, strict=True))
                ok = p1 > 0
                g = np.where(ok, p1 * (np.log2(np.maximum(p1, 1) / np.maximum(p1 + n1, 1)) - log2(p / (p + n))), -1.0)
                i = int(g.argmax()) if len(g) else -1
                if i >= 0 and g[i] > gain:
                    best, gain = Test(name, at_least, float(cuts[i])), float(g[i])
        if best is None:
            break
        rule += (best,)
        at &= best.rows(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        at = _covered(r, x)
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """An ordered list of rules that reject."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    half = np.arange(len(bad)) % 3 > 0
    while len(rules) < MAX_RULES and bad[left].any() and (~bad[left]).any():
        grow, prune = left & half, left & ~half
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow]) if bad[grow].any() else ()
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        at = _covered(rule, x) & left
        p, n = int(bad[at].sum()), int((~bad[at]).sum())
        if p < 5 or (p + 1) / (p + n + 2) < precision:
            break
        rules.append(rule)
        left &= ~at
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, precision: float = PRECISION) -> list[Rule]:
    """Learn from docs(doc_id, text) with labels(doc_id, quality). What the base rule rejects is left out."""
    known = labels.filter("quality is not null").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality"))
    # The bound is taken on ids alone, before any text is read by the statistics.
    chosen = known.orderBy(F.xxhash64("_id"), "_id", "_quality").limit(max_rows) if max_rows else known
    # At most max_rows labels: broadcast, so that no text is shuffled.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen) if max_rows else chosen, F.col("doc_id") == F.col("_id"))
    found = statistics(joined, "doc_id", "_quality").filter(~base_failed()).select("doc_id", "_quality", F.struct(*[c.alias(k) for k, c in features().items()]).alias("_x"))
    # Rows of one id count once for each of its labels, so no more than the labels reach the driver.
    rows = found.groupBy("doc_id", "_quality").agg(F.min("_x").alias("_x")).select("doc_id", "_quality", "_x.*").collect()
    rows.sort(key=lambda r: (r.doc_id * 2654435761 & 0xFFFFFFFF, r.doc_id, r._quality))
    if not rows:
        return []
    x = {k: np.array([r[k] for r in rows], float) for k in features()}
    return learn(x, np.array([r._quality == 0 for r in rows]), precision)


def verdict(rules: list[Rule]) -> Column:
    """True where a document is kept: the base rule first, then the list in order."""
    out = F.when(base_failed(), F.lit(False))
    for rule in rules:
        test = rule[0].column()
        for more in rule[1:]:
            test = test & more.column()
        out = out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """The columns keep of docs with their statistics, base_failed and kept."""
    return statistics(docs, *keep).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))


def digests(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("text"))
    return judge(packed, rules, "_row").filter("kept").select("_row.*")
