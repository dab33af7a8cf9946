"""Text functions as Spark columns: phrases, title keys, ids, feature texts.

Spark has no NFKC and no full case folding. ``phrase`` therefore has a built-in form
for ASCII (exact there) and an Arrow form for any text, which is applied to distinct
keywords only.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.session import ship

#: White space of Unicode strings, with the separators U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Word characters by category (letters, numbers, underscore).
WORDS = r"([\p{L}\p{N}_]+)"
#: What parts words: all but letters, numbers (by category) and underscores.
GAPS = r"[^\p{L}\p{N}_]+"
# Lengths in code points.
TITLE_LENGTH, SOURCE_LENGTH, TYPE_LENGTH, KEYWORD_LENGTH, KEYWORDS = 2000, 300, 100, 100, 20


def short_id(c: Column | str) -> Column:
    """The text after the last slash."""
    return F.substring_index(c, "/", -1)


def strip(c: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    return F.length(strip(c)) == 0


def phrase_ascii(c: Column | str) -> Column:
    """A phrase in normal form, exact for ASCII text: lower case, single spaces."""
    return F.lower(strip(F.regexp_replace(c, f"{SPACE}+", " ")))


def fold_phrase(value: str) -> str:
    """NFKC, case folding, single spaces."""
    return " ".join(unicodedata.normalize("NFKC", value).casefold().split())


def _phrases(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else fold_phrase(v) for v in values.to_pylist()], pa.string())


def normalise_keywords(keywords: DataFrame, column: str = "keyword", into: str = "keyword") -> DataFrame:
    """Rows of ``keywords`` with ``column`` in normal form. ASCII goes through built-in
    functions; what else there is is folded in Arrow batches, each distinct text once."""
    ship(keywords.sparkSession)
    plain = F.col(column).rlike(r"^[\x00-\x7F]*$")
    rest = keywords.where(~plain).select(F.col(column).alias("__raw")).distinct()
    folded = rest.select("__raw", F.arrow_udf(_phrases, "string")("__raw").alias("__folded"))
    return (
        keywords.join(folded, F.col(column) == F.col("__raw"), "left")
        .withColumn(into, F.when(plain, phrase_ascii(column)).otherwise(F.col("__folded")))
        .drop("__raw", "__folded")
    )


def fold_case(c: Column | str) -> Column:
    """Full case folding: what Python's ``casefold`` gives, but for Cherokee letters.

    Upper case writes out what folding does (sharp s, ligatures); lower case alone does
    not. The dotless i stays what it is, and a final sigma is a sigma."""
    # a change of letters in between keeps the optimizer from dropping a step as idle;
    # replace() looks for bytes, translate() makes an object of every letter
    swap = lambda x, old, new: F.replace(x, F.lit(old), F.lit(new))
    first = swap(F.lower(c), "\u0131", "\ue000")
    second = swap(F.upper(first), "\ue000", "\ue001")
    return swap(swap(F.lower(second), "\ue001", "\u0131"), "\u03c2", "\u03c3")


def title_key(c: Column | str) -> Column:
    """The words of a title, case-folded, joined by single spaces."""
    return F.trim(F.regexp_replace(fold_case(c), GAPS, " "))


def _keywords(c: Column, separator: str) -> Column:
    cut = F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, KEYWORDS), lambda x: F.substring(x, 1, KEYWORD_LENGTH))
    return F.array_join(cut, separator)


def feature_text(title: Column, source: Column, kind: Column, keywords: Column) -> Column:
    """What a scorer is shown of a record, and nothing else."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.substring(title, 1, TITLE_LENGTH)),
        F.concat(F.lit("Source: "), F.substring(source, 1, SOURCE_LENGTH)),
        F.concat(F.lit("Type: "), F.substring(kind, 1, TYPE_LENGTH)),
        F.concat(F.lit("Keywords: "), _keywords(keywords, "; ")),
    )


def split_text(title: Column, keywords: Column) -> Column:
    """What a record is clustered by: title and keywords, without its source."""
    return F.concat(F.substring(title, 1, TITLE_LENGTH), F.lit(" "), _keywords(keywords, " "))


def insufficient_metadata(title: Column, source: Column, keywords: Column) -> Column:
    """Title, source and all keywords are blank; the type doesn't count."""
    some = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: ~is_blank(k))
    return is_blank(title) & is_blank(source) & ~some


def hash_bucket(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def label_text(c: Column) -> Column:
    """A label without brackets, which some models read as structure: an opening
    parenthesis becomes a comma, other brackets go."""
    return F.translate(c, "()[]", ",")
