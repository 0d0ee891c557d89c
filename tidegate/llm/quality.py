"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

WHITE = r"\x20\x09-\x0D"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 3

#: Frequent words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by are this from or "
    "le la les de des et en un une du que est pour dans qui sur par au "
    "der die das und ist von mit den zu im für ein eine auf als sich dem "
    "el los las y que una por con para del se su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A measure must lie between low and high, both included; a null measure or limit passes."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def passed(self) -> Column:
        value = F.expr(self.measure)
        checks = [value >= F.lit(self.low)] if self.low is not None else []
        checks += [value <= F.lit(self.high)] if self.high is not None else []
        out = F.lit(True)
        for check in checks:
            out &= F.coalesce(check, F.lit(True))
        return out


#: Measures are SQL over the columns of `measures`. The first two are the base.
BASE_RULES = (
    Rule("long_enough", "n_words", low=50),
    Rule("few_repeated_windows", "100 * n_repeat_words - 50 * n_words", high=0),
)
RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", low=2.0, high=15.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", high=0.1),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", high=0.3),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("words_with_letters", "n_letter_words / nullif(n_words, 0)", low=0.8),
    Rule("bullet_lines", "n_bullet_lines / nullif(n_lines, 0)", high=0.9),
)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with counts of their words, symbols, lines and repetitions; a null text counts as empty.

    Adds n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a word, and those
    equal to an earlier one), n_repeat_words (words inside windows of three that occur twice or more), n_stop_words,
    n_letter_words, n_bullet_lines. Columns of `docs` with these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    split = docs.withColumns({
        "_text": text,
        "_words": F.regexp_extract_all(text, F.lit(f"[^{WHITE}]+"), F.lit(0)),
        "_lines": F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{WHITE}]")),
    })
    n = F.size("_words")
    words = F.col("_words")
    starts = F.when(n >= REPEAT_WINDOW, F.sequence(F.lit(0), n - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.struct(
        F.xxhash64(*[F.get(words, i + k) for k in range(REPEAT_WINDOW)]).alias("h"), i.alias("i")))
    sorted_ = F.col("_windows")
    repeated = F.filter(sorted_, lambda w, k: (w["h"] == F.get(sorted_, k - 1)["h"]).eqNullSafe(True)
                        | (w["h"] == F.get(sorted_, k + 1)["h"]).eqNullSafe(True))
    covered = F.flatten(F.transform(repeated, lambda w: F.array(*[w["i"] + k for k in range(REPEAT_WINDOW)])))
    lowered = lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    count = lambda column: column.cast("long")
    return split.withColumn("_windows", F.sort_array(windows)).withColumns({
        "n_words": count(n),
        "word_chars": count(F.length(F.array_join("_words", ""))),
        "n_symbols": count(F.regexp_count("_text", F.lit(SYMBOLS))),
        "n_lines": count(F.size("_lines")),
        "n_dup_lines": count(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_repeat_words": count(F.size(F.array_distinct(covered))),
        "n_stop_words": count(F.size(F.filter(words, lambda w: lowered(w).isin(STOP_WORDS)))),
        "n_letter_words": count(F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))),
        "n_bullet_lines": count(F.size(F.filter("_lines", lambda line: line.rlike(f"^[{WHITE}]*[-*•]")))),
    }).drop("_text", "_words", "_lines", "_windows")


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES,
                text_col: str = "text") -> DataFrame:
    """The documents with their measures, `base_failed`, `failed` (names of broken rules) and `kept`.

    One projection over the input: no shuffle, every row comes out once, with all its columns.
    """
    broken = lambda rule: F.when(~rule.passed(), F.lit(rule.name))
    return (
        measures(docs, text_col)
        .withColumn("failed", F.array_compact(F.array(*[broken(r) for r in (*base, *rules)])))
        .withColumn("base_failed", F.arrays_overlap("failed", F.array(*[F.lit(r.name) for r in base])))
        .withColumn("kept", F.size("failed") == 0)
    )
