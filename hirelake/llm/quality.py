"""Quality rules: one threshold table compiled into a single Spark projection.

The measures are built-in expressions over the split words and lines, so no user function
runs.  ``let`` binds an array once as a lambda variable; nothing is exploded or shuffled.

Cases: a null or empty text has no words and fails the base rule; repeated rows are judged one
by one; an empty table gives an empty result; columns other than the id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPLIT, let, only

#: Frequent words of the languages at hand, fixed values.
STOP_WORDS = (
    "the of and to in a is that for it with as on by be at this are was or from an not "
    "de la le et les des en un une du est que pour dans qui par sur au avec pas "
    "der die und in den von zu das mit sich auf für ist im dem nicht ein eine als auch "
    "el los se del las por con no para su al lo como más o"
).split()

#: measure, least and most allowed value (null: no bound), and the words from which it counts.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0, 50),
    ("symbols_per_word", None, 0.3, 50),
    ("stop_word_share", 0.02, None, 50),
    ("dup_line_share", None, 0.5, 50),
    ("bullet_line_share", None, 0.95, 50),
    ("ellipsis_line_share", None, 0.6, 50),
    ("alpha_word_share", 0.4, None, 50),
)

SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by hash, so that equal ones are neighbours; a window that equals a
    neighbour marks its three places.
    """

    def counted(ws: Column) -> Column:
        last = F.size(ws) - 3
        windows = F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
        )

        def places(s: Column) -> Column:
            # The sorted array beside itself, shifted by one either way, without index look-ups.
            same = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
            starts = F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(last < 1, F.lit(0)).otherwise(let(F.sort_array(windows), places))

    return let(words, counted).cast("long")


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and the other counts that the threshold table draws on."""
    df = only(documents, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, "[\\x20\\x09-\\x0D]", "")) > 0)
    is_stop = lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(list(dict.fromkeys(STOP_WORDS)))
    counted = let(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("d"), F.size(F.filter(a, lambda x: x.rlike("^\\s*[-*•]"))).alias("b"), F.size(F.filter(a, lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).alias("e")))
    words = lambda body: let(words_of(F.col("text")), body)
    return df.select(
        "doc_id",
        words(
            lambda ws: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                repeated_words(ws).alias("n_repeat_words"),
                F.size(F.filter(ws, is_stop)).cast("long").alias("n_stop_words"),
                F.size(F.filter(ws, lambda w: w.rlike("\\p{L}"))).cast("long").alias("n_alpha_words"),
            )
        ).alias("w"),
        F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        counted.alias("l"),
    ).select(
        "doc_id", "w.*", "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"),
        F.col("l.n").cast("long").alias("n_lines"), F.col("l.b").cast("long").alias("n_bullet_lines"), F.col("l.e").cast("long").alias("n_ellipsis_lines"),
    )


def judged(documents: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measured`` with base_failed, the failed rules' names and kept."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measures = {
        "mean_word_chars": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_share": per("n_stop_words", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "bullet_line_share": per("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": per("n_ellipsis_lines", "n_lines"),
        "alpha_word_share": per("n_alpha_words", "n_words"),
    }
    failed = []
    for name, least, most, from_words in thresholds:
        low = measures[name] < least if least is not None else F.lit(False)
        high = measures[name] > most if most is not None else F.lit(False)
        failed.append(F.when((F.col("n_words") >= from_words) & (low | high), F.lit(name)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = measured(documents, id_col, text_col).withColumn("base_failed", base)
    return df.withColumn("failed_rules", F.array_compact(F.array(*failed))).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
