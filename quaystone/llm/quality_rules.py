"""Quality rules with risk-controlled thresholds.

Every document gets counts (words, symbols, repeated lines and word triples). Two base rules reject short and
repetitive texts. For further metrics the cutoff is chosen on labelled holdout documents, per stratum: a cutoff is
certified if the exact (Clopper-Pearson) upper bound of its false rejection rate, at a level shared out over all
strata, metrics and candidate cutoffs (Bonferroni), is at most the metric's share of the allowed rate. The strictest
certified cutoff holds; with none, the metric rejects nothing.

The guarantee is about documents that pass the base rules, which are fixed: of those at most ALLOWED of the good ones of
a stratum are rejected, with confidence 1 - LEVEL over all strata.

Cases: a null or empty text has no words and fails the base rule; a stratum without labels (or null) has no cutoffs;
repeated documents each count and each get a row; a document labelled twice is good if any label says so; columns
beyond those named are ignored, whatever their names. The pipeline's stage decides per row.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.common import add_columns, cut, salted_join, table, text_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
#: Allowed rate of good documents rejected in a stratum, by all metrics together, and the level of the guarantee.
ALLOWED, LEVEL = 0.04, 0.05
#: Candidate cutoffs; a document is rejected by a metric above its cutoff.
GRID = {
    "symbol_ratio": [round(0.01 * i, 2) for i in range(1, 41)],
    "dup_line_ratio": [round(0.02 * i, 2) for i in range(1, 41)],
    "repeat_ratio": [round(0.02 * i, 2) for i in range(1, 26)],
    "mean_word": [3 + 0.5 * i for i in range(40)],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Strata whose cutoffs are sent to every executor at most; more take part in a join that is dealt into parts.
MOST_STRATA = 10_000


def count_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        times, end = Counter(triples), 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


def _count_batch(texts: list[bytes]) -> list:
    return list(zip(*map(count_text, texts), strict=True)) if texts else [[] for _ in COUNTS]


def count_documents(docs: DataFrame, stratum: str = "lang", kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and __stratum, the counts and the metrics under names that begin with __, a row per document."""
    src = docs.withColumn("__stratum", F.col(stratum).cast("string"))
    out = add_columns(src, text_bytes(), _count_batch, ", ".join(f"__{c} long" for c in COUNTS), *kept, "__stratum")
    c = lambda name: F.col(f"__{name}")
    ratio = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return out.withColumns({
        "__symbol_ratio": ratio("n_symbols", "word_chars"),
        "__dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "__repeat_ratio": ratio("n_repeat_words", "n_words"),
        "__mean_word": ratio("word_chars", "n_words"),
        "__base_failed": (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PCT * c("n_words")),
    })


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(n: int, rejected: list[int], grid: list[float], rate: float, level: float) -> float | None:
    """The strictest cutoff whose upper bound of the rejection rate is at most rate; rejected[i]: good ones above grid[i]."""
    for cutoff, k in zip(grid, rejected, strict=True):
        if k / max(n, 1) <= rate and n and binomial_cdf(k, n, rate) <= level:
            return cutoff
    return None


def cutoffs(counted: DataFrame, labels: DataFrame, allowed: float = ALLOWED, level: float = LEVEL, grid: dict = GRID) -> DataFrame:
    """__stratum and one cutoff column per metric (null: none certified), from all labelled good documents that pass the base rules."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = counted.where(~F.col("__base_failed") & F.col("__stratum").isNotNull()).select("doc_id", "__stratum", *[f"__{m}" for m in grid]).join(good, "doc_id", "left_semi")
    above = lambda m: [F.sum((F.col(f"__{m}") > c).cast("long")).alias(f"{m}_{i}") for i, c in enumerate(grid[m])]
    tallies = cut(held.groupBy("__stratum").agg(F.count("*").alias("n"), *[x for m in grid for x in above(m)]))
    strata = tallies.count()
    each, rate = level / max(1, strata * sum(map(len, grid.values()))), allowed / len(grid)

    def pick(frames):
        for pdf in frames:
            yield pd.DataFrame({"__stratum": pdf["__stratum"]} | {
                f"__{m}_cutoff": [choose(int(r["n"]), [int(r[f"{m}_{i}"]) for i in range(len(g))], g, rate, each) for _, r in pdf.iterrows()]
                for m, g in grid.items()
            })

    return tallies.mapInPandas(pick, "__stratum string, " + ", ".join(f"__{m}_cutoff double" for m in grid))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", kept: tuple[str, ...] = ("doc_id",), **risk) -> DataFrame:
    """The kept columns (doc_id among them), the counts, __base_failed and __kept, a row per document."""
    counted = cut(count_documents(docs, stratum, kept))
    chosen = cut(cutoffs(counted, labels, **risk))
    out = counted.join(F.broadcast(chosen), "__stratum", "left") if chosen.count() <= MOST_STRATA else salted_join(counted, chosen, ["__stratum"], "doc_id", "left")
    over = F.lit(False)
    for m in risk.get("grid", GRID):
        over = over | F.coalesce(F.col(f"__{m}") > F.col(f"__{m}_cutoff"), F.lit(False))
    return out.withColumn("__kept", ~F.col("__base_failed") & ~over)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (*COUNTS[:5], "base_failed", "kept")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept: each is written once beside its counts and read again with the verdict, so no join moves texts."""
    return judge(docs, table(spark, sf_dir, "labels"), kept=tuple(docs.columns)).where("__kept").select(*docs.columns)


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL: dict[str, str] = {}
