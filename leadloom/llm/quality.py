"""Line-first quality cleaning with Spark SQL functions alone.

Each line is judged by itself; failing lines go, and a document that loses too much text with them
is rejected. Counts of the whole text decide beforehand about very short or repetitive documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import set_aside

#: Words of a document at least; percent of its words at most that lie in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Percent of the text's characters that the failing lines may hold at most.
MOST_LOST = 40
#: Characters of a line for each boilerplate phrase in it at most.
BOILERPLATE_CHARS = 120
#: Bits of a packed window that are its place; the others are of its hash.
PLACE_BITS = 28

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Where a sentence may end.
ENDING = r"""[.!?…:;。！？]["'”’»)\]]*$"""
#: A sentence that ends within a line.
INSIDE = r"""[.!?…:;]["'”’»)\]]*\s"""
#: Words of pages about themselves, in lower case.
BOILERPLATE = (
    r"all rights reserved|\blicen[sc]ed? under\b|released under the|terms of (use|service)|privacy policy|cookie|javascript|copyright"
    r"|subscribe|newsletter|sign (in|up)|log ?in|click here|lorem ipsum|powered by|share this"
)


def failing(line: Column, symbols: Column) -> Column:
    """Whether a line (blanks at its ends removed) breaks a punctuation, navigation or boilerplate rule; blank lines do not.

    `symbols` says whether the document has any symbol at all. A line is boilerplate if it has a phrase of it for every
    BOILERPLATE_CHARS of its characters.
    """
    dense = symbols & ((F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))) * 20 > F.length(line))
    punctuation = ~(line.rlike(ENDING) | line.rlike(INSIDE)) | line.rlike(r"[!?]{2,}\s+\S+[!?]{2,}") | dense
    navigation = line.rlike(r"(\s[|»>·•/]\s.*){2,}")
    boilerplate = F.regexp_count(F.lower(line), F.lit(BOILERPLATE)) * BOILERPLATE_CHARS >= F.length(line)
    return (line != "") & (punctuation | navigation | boilerplate)


#: Columns that are made and dropped on the way.
WORKING = ["_words", "_full", "_sorted", "_maybe", "_pairs", "_places", "_lines", "_stay", "_lost"]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text.

    A null text has no words. Windows are compared by 64-bit hashes: first packed with their places and
    sorted, to find those that may be repeated; then only these with all bits.
    """
    docs, back = set_aside(docs, WORKING)
    own = F.coalesce(F.col(text), F.lit(""))
    window = "xxhash64(_words[{0}], _words[{0} + 1], _words[{0} + 2])"
    high, low = -(1 << PLACE_BITS), (1 << PLACE_BITS) - 1
    return back(
        docs.withColumn("_words", F.array_remove(F.split(own, BLANKS), ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", (F.length(own) - F.length(F.regexp_replace(own, SYMBOLS, ""))).cast("long"))
        .withColumn("_full", F.filter(F.split(own, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
        .drop("_full")
        .withColumn("_sorted", F.expr(f"sort_array(if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, n_words - 3), i -> ({window.format('i')} & {high}L) | i)))"))
        .withColumn("_maybe", F.expr(f"transform(filter(_sorted, (x, j) -> (j > 0 and ((x ^ get(_sorted, j - 1)) & {high}L) = 0) or (j + 1 < size(_sorted) and ((x ^ get(_sorted, j + 1)) & {high}L) = 0)), x -> x & {low}L)"))
        .drop("_sorted")
        .withColumn("_pairs", F.expr(f"sort_array(transform(_maybe, i -> struct({window.format('i')} as h, i as i)))"))
        .drop("_maybe", "_words")
        .withColumn("_places", F.expr("sort_array(transform(filter(_pairs, (x, j) -> (j > 0 and x.h = get(_pairs, j - 1).h) or (j + 1 < size(_pairs) and x.h = get(_pairs, j + 1).h)), x -> x.i))"))
        .drop("_pairs")
        .withColumn("n_repeat_words", F.expr("aggregate(transform(_places, (x, j) -> if(j + 1 < size(_places), least(3L, get(_places, j + 1) - x), 3L)), 0L, (a, b) -> a + b)"))
        .drop("_places")
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their counts, base_failed, kept, clean_text, n_lines and n_removed_lines; equally named columns are replaced.

    Failing lines are missing in clean_text. A document is kept unless its counts fail or the lines
    removed hold more than MOST_LOST percent of its characters that are in lines with a word. Null and
    empty texts fail by their counts; very long ones are judged whole; repeated rows are judged alike; an empty
    table gives no rows. Boilerplate is known by English phrases; the other rules hold in any language.
    """
    docs, back = set_aside(docs, WORKING)
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines", "n_removed_lines"]
    counted = with_counts(docs.drop(*made), text)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    chars = lambda ls: F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(F.trim(x)))
    return back(
        counted.withColumn("_lines", lines)
        .withColumn("_stay", F.filter("_lines", lambda x: ~failing(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), F.col("n_symbols") > 0)))
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
        .withColumn("_lost", chars(F.col("_lines")) - chars(F.col("_stay")))
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("_lost") <= MOST_LOST * chars(F.col("_lines"))))
        .withColumn("clean_text", F.array_join("_stay", "\n"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_removed_lines", (F.size("_lines") - F.size("_stay")).cast("long"))
        .drop("_lines", "_stay", "_lost")
    )


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents, their text without the failing lines, other columns as they were."""
    judged = judge(docs.select(*(F.col(c).alias(f"_in_{c}") for c in docs.columns)), "_in_text")
    # Spark would work the filter's expression out anew, with all that it is made of; a numbered row keeps the filter above.
    kept = judged.withColumn("_row", F.monotonically_increasing_id()).filter(F.col("kept") & (F.col("_row") >= 0))
    return kept.select(*(F.col("clean_text" if c == "text" else f"_in_{c}").alias(c) for c in docs.columns))
