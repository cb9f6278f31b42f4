"""Line deduplication, DataFrame functions only.

Lines are reduced to a 128-bit hash of their key.  Hashes are range-partitioned by (hash, document), so that one very
common line is spread over many partitions; a secondary sort by document and position streams the first occurrence of a
key in each document.  Those are counted per key (one partial row per partition and key), and the result is a
compressed bitmap per document of what it loses, not text.  Only ``apply_bitmaps`` touches text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from frisk.functions.keep import Scratch, stored
from frisk.llm.rows import SPACE, ascii_lower, text_key

MIN_CHARS, MIN_DOCUMENTS = 40, 5
_ID = ("__id", "__tk")


def split_lines(text: Column) -> Column:
    """Lines between line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(__id, __tk, pos, h1, h2) of every line whose key has ``min_chars`` code points or more."""
    lines = docs.select(F.col(id_col).alias("__id"), text_key(F.col(text_col)).alias("__tk"),
                        F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select(*_ID, "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select(*_ID, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def first_occurrences(lines: DataFrame) -> DataFrame:
    """The first line of each key in each document: sorted by document and position inside ranges of hashes."""
    ranged = lines.repartitionByRange("h1", "h2", "__id")
    here = Window.partitionBy("h1", "h2", "__id").orderBy("pos")  # the ranges already keep these rows together
    return ranged.withColumn("n", F.row_number().over(here)).filter("n = 1").select("h1", "h2", "__id", "pos")


def repeated_keys(lines: DataFrame, min_documents: int) -> DataFrame:
    """(h1, h2, keeper) of keys in ``min_documents`` documents or more; the keeper is the largest id."""
    per_key = first_occurrences(lines).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("__id").alias("keeper"))
    return per_key.filter(F.col("n") >= min_documents).select("h1", "h2", "keeper")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(__id, __tk, drops): for documents that lose lines, word number -> 64 bits, a set bit is a line to drop.

    Words without a set bit are left out, so a document costs as much as it loses.  Rows with the same id and text share one
    bitmap; rows with one id and different texts are told apart by the text's hash, and count as one document.
    Null ids are one document, smaller than all others.  An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    lines = scratch.keep(line_table(docs, id_col, text_col, min_chars))
    common = scratch.keep(repeated_keys(lines, min_documents))  # own table: its size is known to the join, which can split a hot key
    lost = lines.join(common, ["h1", "h2"]).filter(~F.col("__id").eqNullSafe(F.col("keeper")))
    words = lost.groupBy(*_ID, (F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmaps = stored(words.groupBy(*_ID).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("drops")))
    scratch.clear()
    return bitmaps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text_col`` replaced by the lines that stay, plus __n_lines and __n_dropped."""
    last = F.array_max(F.map_keys("drops"))
    dense = F.transform(F.sequence(F.lit(0), last), lambda w: F.coalesce(F.element_at("drops", w), F.lit(0).cast("long")))
    sets = bitmaps.select(*_ID, dense.alias("__bits"))
    rows = docs.withColumn("__key", text_key(F.col(text_col)))
    # one join form at every size: a broadcast below Spark's limit would make disk jump where it ends
    joined = rows.join(sets.hint("shuffle_hash"), rows[id_col].eqNullSafe(sets["__id"]) & (rows["__key"] == sets["__tk"]), "left")

    def stays(line, k):
        word = F.shiftright(k, 6)
        bit = F.when(word < F.size("__bits"), F.getbit(F.get("__bits", word), k % 64)).otherwise(F.lit(0))
        return bit == 0

    lines = split_lines(F.col(text_col))
    whole = F.col("__bits").isNull()
    n_lines = F.size(lines).cast("long")
    kept = F.when(whole, lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("__lines", kept).withColumn("__n_lines", n_lines)
    return out.select(*[F.array_join("__lines", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns],
                      "__n_lines", (F.col("__n_lines") - F.size("__lines")).alias("__n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Drop common lines everywhere but in the largest document holding them; a null text becomes an empty one.

    Extra columns pass through; names starting with two underscores are reserved.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars, min_documents), id_col, text_col)
