"""Lines that an earlier document has too: keep bitmaps by document from a range-partitioned stream of line hashes. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import lower_ascii, shuffle_partitions, written

#: White space that does not count at either end of a line, and the least code points of a line that can go.
WHITE = " \t\n\x0b\x0c\r"
LEAST = 10
#: Bits of a hash that name its range: so many ranges are counted to find those with a hot line.
RANGE_BITS = 12


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def _text(docs: DataFrame, text: str) -> DataFrame:
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id"), data.alias("text"), F.xxhash64(data).alias("version"))


def line_hashes(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, version, pos, h1, h2) of each line that can go: its place, and 128 bits that stand for its key. ``version`` tells rows of one id apart by their text."""
    rows = _text(docs, text).select("doc_id", "version", F.posexplode(F.transform(F.split("text", "\n"), line_key)).alias("pos", "key"))
    return rows.where(F.length("key") >= least).select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(42), "key").alias("h2"))


def in_pieces(lines: DataFrame) -> DataFrame:
    """``lines`` with ``pieces`` and ``piece``: rows of a range of hashes that holds more than half a partition's share are cut by document.

    The counts of 2**RANGE_BITS ranges, added up in the map tasks, go to the driver; a table of the hot ones among them comes back by broadcast.
    """
    spark, n = lines.sparkSession, shuffle_partitions(lines.sparkSession)
    part = F.shiftrightunsigned("h1", 64 - RANGE_BITS)
    counts = {r["part"]: r["count"] for r in lines.groupBy(part.alias("part")).count().collect()}
    share = sum(counts.values()) / n
    hot = [(p, math.ceil(4 * c / share)) for p, c in counts.items() if c > share / 2]
    if not hot:
        return lines.select("*", F.lit(1).alias("pieces"), F.lit(0).alias("piece"))
    table = F.broadcast(spark.createDataFrame(hot, "part long, pieces int"))  # 2**RANGE_BITS rows at most
    rows = lines.withColumn("part", part).join(table, "part", "left").drop("part").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    return rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int"))


def _later(*keys: str) -> Column:
    """True for a line whose key streamed by before, in a smaller document: order is by document (null last), then place."""
    stream = Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ~F.col("doc_id").eqNullSafe(F.first("doc_id").over(stream))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, version, n_dropped, keep) of each document that loses lines.

    ``keep`` lists, by number, the 64-bit words of its bitmap in which some line goes (bit i of word w stands for line 64 w + i); words
    whose lines all stay are left out. Hashes are range-partitioned with documents and places in order: each key's first document passes first, all others lose
    the line. A hot range is cut into pieces by document; of each piece only the first document of a key meets the others' in a second, small stream.
    """
    lines = in_pieces(written(line_hashes(docs, least, text)))
    keys = ["h1", "h2", "piece"]
    stream = lines.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys)
    marked = written(stream.withColumn("later", _later(*keys)).where("later or pieces > 1").select("doc_id", "version", "pos", "h1", "h2", "later"))
    firsts = marked.where("not later").withColumn("later", _later("h1", "h2"))
    gone = marked.where("later").unionByName(firsts.where("later"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos").bitwiseAND(63))
    words = gone.groupBy("doc_id", "version", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone"))
    one = F.struct("word", F.bitwise_not("gone").alias("bits"))
    return words.groupBy("doc_id", "version").agg(F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(one)).alias("keep"))


def kept_lines(text: Column, keep: Column) -> Column:
    """The text without the lines whose bit is not set."""
    before = lambda i: F.when(i > 0, F.get(keep, i - 1)["word"]).otherwise(F.lit(-1))
    full = F.flatten(F.transform(keep, lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("long"), w["word"] - before(i) - 1), F.array(w["bits"]))))
    stays = lambda bits, i: F.getbit(F.coalesce(F.get(bits, F.shiftright(i, 6)), F.lit(-1).cast("long")), i.bitwiseAND(63)) == 1
    # an array of one, so that the bitmap is unfolded once
    return F.element_at(F.transform(F.array(full), lambda bits: F.array_join(F.filter(F.split(text, "\n"), lambda _, i: stays(bits, i)), "\n")), 1)


def without_repeated_lines(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep, kept) of every row: its lines, how many go, the keep bitmap (null: all stay) and the text left.

    A line goes if its key (``line_key``) has ``least`` code points or more and a document with a smaller id holds it too. Rows that
    share an id are one document; those without an id are the last one. A null text counts as empty, and an empty text is
    one empty line. A key that holds a third of all lines is cut into pieces; a very long text is one row wherever it goes.
    Equality of keys is that of 128-bit hashes. Other columns are not read; an empty table gives no rows.
    """
    maps = keep_bitmaps(docs, least, text).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "n_dropped", "keep")
    rows = _text(docs, text)
    out = rows.join(maps, rows["doc_id"].eqNullSafe(maps["_doc"]) & (rows["version"] == maps["_version"]), "left")
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept_lines(F.col("text"), F.col("keep")))
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep", kept.alias("kept"))


def op11_first_lines(spark, sf_dir) -> DataFrame:
    """One row per document: its lines, those that go, and a digest of the text left."""
    from tallyspark.llm.common import table

    out = without_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.line, k.i, f.least IS NULL OR k.doc_id = f.least AS stays FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
