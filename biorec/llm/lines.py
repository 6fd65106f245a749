"""Line deduplication: lines that many documents repeat stay in the first of them only.

A text is split at ``\\n``. A line's key is the line without the contract's white space at both ends,
A-Z lower-cased. A key of at least ``LEAST_POINTS`` code points that ``least_docs`` documents or more
hold loses all its lines, except in the document of the smallest id that holds it.

1. Explode the lines and hash their keys (two 64-bit hashes with seeds of their own); these rows, which
   hold no text, are written.
2. Make (key, document) distinct and count the documents of each key. A key that very many documents
   hold is counted by partial aggregates. The written lines are joined with the keys over the
   threshold; what is found in another document than the one that keeps it is a dropped position.
   The join can be split where a key is hot.
3. A document's positions are joined with it by two 64-bit hashes of its id and text, and its other
   lines are put together in their order.

Documents are told apart by their ids: rows that share one count as one document for the threshold
and keep or lose the same keys; rows equal in id and text get equal results, in a row each. Rows
without an id count as one document, which comes after all others. A null or empty text is one empty
line. Where all lines go, the text is empty. Other columns, whatever their names, ride along in
``doc``. An empty table gives no rows. All work is DataFrame work; a position list is no longer than
its document has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biorec.llm.common import few, materialize

LEAST_POINTS = 10
LEAST_DOCS = 2
_SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_SPACES))


def line_key(line: Column) -> Column:
    bare = _bare(line)
    # Where all is ASCII, the plain lower case is that of A-Z alone.
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def two_hashes(*columns: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds."""
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def _row_hashes(text: Column, doc_id: Column) -> list[Column]:
    return [h.alias(n) for h, n in zip(two_hashes(F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), ("r1", "r2"))]


def keyed_lines(docs: DataFrame, least_points: int) -> DataFrame:
    """A row for each line whose key is long enough: doc_id, the row's hashes, the position, the key's hashes."""
    # The row's hashes are made below the explode, once for each row; a line's key once for both of its hashes.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_row_hashes(docs["text"], docs["doc_id"]), split_lines(docs["text"]).alias("lines"))
    long = rows.select("doc_id", "r1", "r2", F.posexplode("lines").alias("pos", "line")).where(F.char_length(_bare(F.col("line"))) >= least_points)
    return long.select("doc_id", "r1", "r2", "pos", *[h.alias(n) for h, n in zip(two_hashes(line_key(F.col("line"))), ("h1", "h2"))])


def repeated_keys(keyed: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Of ``keyed_lines``, the keys of at least ``least_docs`` documents: h1, h2, n_docs, keep_id (null if only documents without an id hold it)."""
    held = keyed.select("h1", "h2", "doc_id").distinct()
    counts = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("keep_id"))
    return counts.where(F.col("n_docs") >= least_docs)


def drop_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_points: int = LEAST_POINTS) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc (the row), kept (its text without the dropped lines), n_lines, n_dropped."""
    keyed = materialize(keyed_lines(docs, least_points), "lines")
    repeated = materialize(repeated_keys(keyed, least_docs).select("h1", "h2", "keep_id"), "line-keys")
    lost = keyed.join(few(repeated), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    lost = lost.groupBy("r1", "r2").agg(F.collect_set("pos").alias("lost"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *_row_hashes(docs["text"], docs["doc_id"]))
    marked = rows.join(lost, ["r1", "r2"], "left").select("doc", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))

    def rest(found: Column) -> Column:
        """The lines at the positions that are left; each list is made once."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(found["lines"]) - 1), found["lost"])
        return F.struct(F.array_join(F.transform(stay, lambda i: found["lines"][i]), "\n").alias("kept"), F.size(found["lines"]).alias("n"))

    found = F.struct(split_lines(F.col("doc.text")).alias("lines"), F.col("lost"))
    out = marked.select("doc", F.size("lost").cast("long").alias("n_dropped"), F.inline(F.transform(F.array(found), rest)))
    return out.select("doc", "kept", F.col("n").cast("long").alias("n_lines"), "n_dropped")


SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
found AS (SELECT key, min(doc_id) AS keep_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep_id AS gone FROM keyed k LEFT JOIN found f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
