"""Line-first quality rules: clean lines, then reject documents that lose too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logharrow.llm.common import GAP, WORD
from logharrow.operators.pin import pin

# A document goes when its failing lines hold more than this share of its characters.
MAX_LOST = 0.5
# Words in a window that counts as repeated, and the limits of the base rules.
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Punctuation: a line has a sentence end somewhere and few symbols for its words.
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(?:[\x20\x09-\x0D]|$)"
SYMBOLS = r"[#*$%&|<>]"
MAX_SYMBOLS_PER_WORD = 0.3
# Navigation: separators between very short entries.
SEPARATORS = r"(?:^|[\x20\x09-\x0D])(?:[|>»•·/]|::|->)(?:[\x20\x09-\x0D]|$)"
MAX_WORDS_PER_ENTRY = 4
# Boilerplate: the line is short and says one of these.
BOILERPLATE = (
    r"(?i)(?:^|[^a-z])(?:accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)"
    r"|all rights reserved|enable javascript|click here|sign in|log in|subscribe (?:now|to)"
    r"|share (?:this|on)|read more|back to top|skip to (?:main )?content|lorem ipsum)(?:[^a-z]|$)"
)
BOILERPLATE_WORDS = 25


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_fails(line: Column) -> Column:
    """Whether a line with words breaks the punctuation, navigation or boilerplate rule."""
    words = F.regexp_count(line, F.lit(WORD))
    symbols = F.regexp_count(line, F.lit(SYMBOLS))
    entries = F.regexp_count(line, F.lit(SEPARATORS))
    punctuation = ~F.rlike(line, F.lit(SENTENCE_END)) | (symbols > words * MAX_SYMBOLS_PER_WORD)
    navigation = (entries >= 2) & (words <= (entries + 1) * (MAX_WORDS_PER_ENTRY + 1))
    boilerplate = F.rlike(line, F.lit(BOILERPLATE)) & (words <= BOILERPLATE_WORDS)
    return punctuation | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes within one text. Only texts that repeat a window
    pay for the sort that finds which.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))

    def covered(windows: Column) -> Column:
        marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.transform(
                s,
                lambda x, k: F.when(
                    (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                ),
            )
            return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

        def total(at: Column) -> Column:
            steps = F.transform(
                at, lambda x, k: F.coalesce(F.least(x - F.get(at, k - 1), F.lit(WINDOW)), F.lit(WINDOW))
            )
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(let(marked, twice), total)

    some = let(
        windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(some).cast("long")


def judged(docs: DataFrame, text_col: str, max_lost: float) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with all counts and the verdict beside it."""
    df = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = pin(
        df,
        words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)),
        lines=F.filter(F.split("text", "\n", -1), lambda line: F.rlike(line, F.lit(WORD))),
    )
    df = pin(
        df,
        n_words=F.size("words").cast("long"),
        word_chars=F.length(F.array_join("words", "")).cast("long"),
        n_symbols=F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=repeated_words(F.col("words")),
        good=F.filter("lines", lambda line: ~line_fails(line)),
    )
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda a, line: a + F.length(line))
    df = pin(df, all_chars=chars(F.col("lines")), good_chars=chars(F.col("good")))
    lost = F.when(F.col("all_chars") == 0, F.lit(0.0)).otherwise(1 - F.col("good_chars") / F.col("all_chars"))
    too_few = F.col("n_words") < MIN_WORDS
    repeats = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    df = df.withColumn("base_failed", too_few | repeats).withColumn("lost_share", lost)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_lost))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = MAX_LOST,
    with_text: bool = True,
) -> DataFrame:
    """Counts, verdict and cleaned text of every document, with built-in functions alone.

    Returns ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, lost_share and, with ``with_text``, clean_text: the lines that pass.
    A document is kept unless base_failed or its failing lines hold more than ``max_lost`` of
    the characters of its lines with words. NULL and empty texts have no words and fail.
    One row per row of ``docs``; nothing is shuffled; other columns are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share"]
    df = judged(docs.select(id_col, text_col), text_col, max_lost)
    clean = [F.array_join("good", "\n").alias("clean_text")] * with_text
    return df.select(F.col("row")[id_col].alias(id_col), *names, *clean)


def good_documents(docs: DataFrame, text_col: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and their texts as they were."""
    return judged(docs, text_col, max_lost).where("kept").select("row.*")
