"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are the runs of characters other than ASCII white space. Null, empty and blank texts have no
words and fail the base rule. Repeated rows are judged each by itself; other columns of the input,
whatever their names, are carried by `measure` only if asked for with `keep`.

Windows of three words are matched by a 64-bit hash of the three words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, let, words_of

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you".split(),
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas pour que qui se ses son sont sur un une vous".split(),
    "de": "als am auch auf aus bei das dem den der des die ein eine einen einer er es für hat ich im in ist mit nicht oder sich sie sind und von war werden wie wir zu zum zur".split(),
    "es": "al como con de del el ella en es ese esta este ha hay la las le lo los más no o para pero por que se sin son su sus un una y ya yo".split(),
}
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A row fails the rule when metric is below `least` or above `most`."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios of an empty text are 0.
RULES = (
    Rule("mean_word_length", "mean_word_length", least=2.0, most=20.0),
    Rule("symbols_per_word", "symbols_per_word", most=0.2),
    Rule("stop_word_ratio", "stop_word_ratio", least=0.08),
    Rule("duplicate_line_ratio", "duplicate_line_ratio", most=0.5),
    Rule("ellipsis_line_ratio", "ellipsis_line_ratio", most=0.5),
    Rule("bullet_line_ratio", "bullet_line_ratio", most=0.9),
)


def repeated_window_words(words: Column, few: int = 128) -> Column:
    """Words that lie in a three-word window found at least twice in the array.

    Window hashes are sorted once; the positions of repeated windows then come from a look-up in the
    repeated hashes when these are few, from a sort of (hash, position) when they are many. Both give
    the same positions.
    """

    def covered(starts: Column) -> Column:
        def steps(s: Column) -> Column:
            width = F.transform(s, lambda at, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - at, F.lit(3))))
            return F.aggregate(width, F.lit(0), lambda a, b: a + b)

        return let(starts, steps)

    def by_hash(g: Column) -> Column:
        def by_sorted(s: Column) -> Column:
            repeated = F.array_distinct(F.filter(s, lambda x, k: x == F.get(s, k + 1)))

            def choose(again: Column) -> Column:
                looked_up = F.filter(F.transform(g, lambda h, i: F.when(F.array_contains(again, h), i)), lambda x: x.isNotNull())

                def neighbours(p: Column) -> Column:
                    twice = F.filter(p, lambda x, k: F.get(p, k - 1)["h"].eqNullSafe(x["h"]) | F.get(p, k + 1)["h"].eqNullSafe(x["h"]))
                    return F.sort_array(F.transform(twice, lambda x: x["i"]))

                sorted_out = let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)
                return F.when(F.size(again) == 0, 0).otherwise(covered(F.when(F.size(again) <= few, looked_up).otherwise(sorted_out)))

            return let(repeated, choose)

        return let(F.sort_array(g), by_sorted)

    n = F.size(words) - 2
    windows = F.transform(F.slice(words, 1, F.greatest(n, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n > 1, let(windows, by_hash)).otherwise(0).cast("long")


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    """The counts that every verdict rests on; `words` must be a column, not an expression."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike("^\\s*[-*•]\\s"))).cast("long"),
        "n_repeat_words": repeated_window_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(sorted({x for v in STOP_WORDS.values() for x in v})))).cast("long"),
    }


def metric_columns() -> dict[str, Column]:
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "duplicate_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
    }


def failed(rule: Rule) -> Column:
    parts = []
    if rule.least is not None:
        parts.append(F.col(rule.metric) < rule.least)
    if rule.most is not None:
        parts.append(F.col(rule.metric) > rule.most)
    return F.coalesce(parts[0] if len(parts) == 1 else parts[0] | parts[1], F.lit(False))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, metrics, the names of failed rules, base_failed and kept for each row of docs."""
    source = docs.select(*keep, F.col("text").alias("__text"), words_of(F.col("text")).alias("__words"))
    base = base_columns(F.col("__text"), F.col("__words"))
    counted = source.select(*keep, *[c.alias(k) for k, c in base.items()])
    measured = counted.select("*", *[c.alias(k) for k, c in metric_columns().items()])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in rules]))
    judged = measured.select("*", base_failed.alias("base_failed"), names.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
