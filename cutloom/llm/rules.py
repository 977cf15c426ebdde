"""Quality rules: a learned decision list over text statistics, by DataFrame functions alone.

Statistics of whole texts are native expressions. Sequential covering then learns, from labelled rows,
conjunctions of thresholds that mark bad documents: a rule grows by the literal of best information gain on
two thirds of the rows that no earlier rule covers, is pruned on the other third, and ends the list when it
no longer is precise there. What reaches the driver is a count for each (statistic, bin). The list is emitted as
ordered Spark conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutloom.llm._tables import documents, labels, materialize, picked

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
BINS = 32
PRECISION = 0.9
LEAST_COVERED = 3
STATISTICS = ("n_words", "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "capitals_ratio", "mark_ratio")


@dataclass(frozen=True)
class Literal:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value < self.threshold


def _conjunction(literals) -> Column:
    out = F.lit(True)
    for literal in literals:
        out = out & literal.column()
    return out


def statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, the base counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the ratios of STATISTICS.

    Null and empty texts have 0 of all (distinct_ratio 1). n_repeat_words counts the words that lie in a
    five-word window which the text has twice or more, its first place included: windows are compared
    by 64-bit hashes of their words. Each array is a column of its own, so no lambda computes one anew.
    """
    c, zero = F.col, F.lit(0)
    text = F.coalesce(c("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = picked(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]{2,}")).cast("long").alias("capitals"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("marks"),
    )
    df = df.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("distinct"),
        "capitals",
        "marks",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.when(F.size("hashes") >= 5, F.transform(F.sequence(zero, F.size("hashes") - 5), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(5)])))
    df = df.withColumn("windows", windows)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twin = lambda e, k: (F.get("ordered", k - 1)["h"] == e["h"]) | (F.get("ordered", k + 1)["h"] == e["h"])
    df = df.withColumn("places", F.sort_array(F.transform(F.filter("ordered", lambda e, k: F.coalesce(twin(e, k), F.lit(False))), lambda e: e["i"])))
    first = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("to"))
    step = lambda a, i: F.struct((a["covered"] + i + 5 - F.greatest(a["to"], i)).alias("covered"), (i + 5).alias("to"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate("places", first, step, lambda a: a["covered"]), zero).cast("long"))
    share = lambda a, b, empty=0.0: F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(empty))
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "word_chars").alias("symbol_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"), share("n_repeat_words", "n_words").alias("repeat_ratio"),
        share("distinct", "n_words", 1.0).alias("distinct_ratio"), share("capitals", "n_words").alias("capitals_ratio"), share("marks", "n_words").alias("mark_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _bin(statistic: str, thresholds: list[float]) -> Column:
    """How many of the thresholds the statistic reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(statistic) >= t))


def _gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before)))


def learn_rules(stats: DataFrame, marks: DataFrame, label_id_col="doc_id", label_col="quality", bad_label=0) -> list[list[Literal]]:
    """Conjunctions, in order; a row that one holds for is bad. Rows with a null label or id don't teach; without labels the list is empty.

    A rule grows while a literal still gains, that is until no good row of the growing part is left in it or no literal tells bad from good; each literal
    leaves fewer rows, and each rule covers LEAST_COVERED bad ones of the pruning part at least, so both end. An id with several labels teaches once for each, and
    repeated rows once for each copy. The third that prunes is crc32(id) mod 3 = 0. Ties go to the first statistic and threshold by name and value.
    """
    c = F.col
    marked = marks.select(c(f"`{label_id_col}`").alias("doc_id"), (c(f"`{label_col}`") == bad_label).alias("bad")).filter("doc_id is not null and bad is not null")
    taught = materialize(
        stats.filter(~base_failed()).join(marked, "doc_id").select(*[c(s).cast("double").alias(s) for s in STATISTICS], c("bad").cast("long").alias("bad"), (F.crc32(c("doc_id").cast("string")) % 3 == 0).alias("prunes")),
        "taught",
    )
    marks_at = [i / BINS for i in range(1, BINS)]
    cuts = taught.agg(*[F.percentile_approx(s, marks_at, 1000).alias(s) for s in STATISTICS], F.sum("bad").alias("bads")).first()
    if not cuts["bads"]:
        return []
    thresholds = {s: sorted(set(cuts[s])) for s in STATISTICS}
    bins = F.array(*[F.struct(F.lit(s).alias("statistic"), _bin(s, thresholds[s]).alias("bin")) for s in STATISTICS])
    learning = materialize(taught.withColumn("bins", bins), "binned")
    rules: list[list[Literal]] = []
    uncovered = F.lit(True)
    while True:
        grown: list[Literal] = []
        while True:
            rows = learning.filter(~c("prunes") & uncovered & _conjunction(grown)).select("bad", F.explode("bins").alias("b")).groupBy("b.statistic", "b.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
            counts = {(r["statistic"], r["bin"]): (r["bad"], r["n"] - r["bad"]) for r in rows}
            bad_all, good_all = (sum(v[k] for (s, _), v in counts.items() if s == STATISTICS[0]) for k in (0, 1))
            if not bad_all or not good_all:
                break
            options = []
            for s in sorted(STATISTICS):
                below = [0, 0]
                for b, t in enumerate(thresholds[s]):
                    bad, good = counts.get((s, b), (0, 0))
                    below = [below[0] + bad, below[1] + good]
                    options.append((_gain(*below, bad_all, good_all), Literal(s, False, t)))
                    options.append((_gain(bad_all - below[0], good_all - below[1], bad_all, good_all), Literal(s, True, t)))
            best = max(options, key=lambda o: o[0], default=(0.0, None))
            if best[0] <= 1e-9:  # also a literal that leaves all rows
                break
            grown.append(best[1])
        if not grown:
            break
        prefixes = [_conjunction(grown[: k + 1]) for k in range(len(grown))]
        sums = [F.sum(F.when(p & (c("bad") == b), 1).otherwise(0)).alias(f"s{k}_{b}") for k, p in enumerate(prefixes) for b in (0, 1)]
        seen = learning.filter(c("prunes") & uncovered).agg(*sums).first()
        worth = [(((seen[f"s{k}_1"] or 0) - (seen[f"s{k}_0"] or 0)) / max((seen[f"s{k}_1"] or 0) + (seen[f"s{k}_0"] or 0), 1), -k) for k in range(len(grown))]
        kept = -max(worth)[1]
        bad, good = seen[f"s{kept}_1"] or 0, seen[f"s{kept}_0"] or 0
        if bad < LEAST_COVERED or bad < PRECISION * (bad + good):
            break
        rules.append(grown[: kept + 1])
        uncovered = uncovered & ~_conjunction(rules[-1])
    return rules


def verdict(rules: list[list[Literal]]) -> tuple[Column, Column]:
    """The list as ordered conditional expressions: the number of the first rule that holds (from 1, 0 if none), and whether the document is kept."""
    first = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(_conjunction(rule), F.lit(k)).otherwise(first)
    return first, first == 0


def judge(docs: DataFrame, marks: DataFrame, id_col="doc_id", text_col="text", **learning) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, rule (first that holds, 0 if none), kept.

    Null and empty texts fail the base. Repeated rows are judged alike; rows with a null id are judged but
    don't teach. An empty table gives an empty table; other columns are ignored.
    """
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    rule, good = verdict(learn_rules(stats, marks, **learning))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & good).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))
