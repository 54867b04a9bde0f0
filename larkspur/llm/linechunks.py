"""Removal of repeated multi-line passages by content-defined chunks of lines (DataFrame functions only).

A text is cut at line feeds. ``r[i]`` is a rolling hash over the hashes of lines i-1 and i;
a chunk ends behind line i where r[i] is smaller than both neighbours. A boundary thus
depends on four lines only: text inserted elsewhere shifts no boundary, and chunks in the
middle of a text have two lines or more, three on average.

Chunks of at least two lines, not all blank, are counted over the corpus by a 64-bit hash
first (narrow rows, partial sums before the shuffle). Only those whose hash repeats are
compared as bytes: they are grouped and joined by the text itself, so chunks that merely
collide stay. The first occurrence, by (doc_id, position), is kept; every other one is
removed from its text. The join may be split by Spark where one passage has a large share.

Keys and decisions are broadcast only if a count shows that they are few; else they are
joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import discard, written

#: Most rows of 64-bit keys, or of decisions per document, that are broadcast.
BROADCAST_ROWS = 200_000

MIN_LINES = 2


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row: it comes out of a generator, which no later expression is merged into."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns but doc_id and text named by their numbers, so that no column's name can clash with one added here."""
    return docs.toDF(*[c.lower() if c.lower() in ("doc_id", "text") else f"c{k}" for k, c in enumerate(docs.columns)])


def _named(plain: DataFrame, columns: list[str], counts: tuple[str, str], removed: Column) -> DataFrame:
    """The columns as they were called, with the new text ``_new``, and two counts."""
    known = {"text": "_new", "doc_id": "doc_id"}
    return plain.select(
        *[F.col(known.get(c.lower(), f"c{k}")).alias(c) for k, c in enumerate(columns) if c.lower() not in counts],
        removed.alias(counts[0]),
        F.coalesce(F.length("text") - F.length("_new"), F.lit(0)).alias(counts[1]),
    )


def with_chunks(docs: DataFrame, only: Column | None = None) -> DataFrame:
    """Add ``_lines`` and ``_chunks``: an array of (first, last) line numbers from 0; null for a null text and where ``only`` doesn't hold."""
    lines = F.split("text", "\n", -1)
    out = _held(docs, "_lines", lines if only is None else F.when(only, lines))
    out = _held(out, "_h", F.transform("_lines", lambda x: F.md5(x)))
    n = F.size("_h")
    out = _held(out, "_r", F.zip_with(F.concat(F.array(F.lit("")), F.slice("_h", 1, n - 1)), F.col("_h"), lambda a, b: F.md5(F.concat(a, b))))
    r = F.col("_r")

    def ends(x: Column, i: Column) -> Column:
        inner = (i > 0) & (x < F.get(r, i - 1)) & (x < F.get(r, i + 1))
        return F.when(inner | (i == n - 1), i)

    out = _held(out, "_ends", F.filter(F.transform("_r", ends), lambda x: x.isNotNull()))
    e = F.col("_ends")
    chunks = F.transform("_ends", lambda x, k: F.struct(F.coalesce(F.get(e, k - 1) + 1, F.lit(0)).alias("first"), x.alias("last")))
    return _held(out, "_chunks", chunks).drop("_h", "_r", "_ends")


def _chunk_text(chunk: Column) -> Column:
    return F.array_join(F.slice("_lines", chunk["first"] + 1, chunk["last"] - chunk["first"] + 1), "\n")


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the whole text) and _gone, the positions of the chunks that are to go; written."""
    several = docs.select("doc_id", "text").where(F.contains("text", F.lit("\n")))
    chunked = with_chunks(several).withColumn("_text", F.xxhash64("text"))
    each = chunked.select("doc_id", "_text", "_lines", F.posexplode("_chunks").alias("pos", "c")).where(F.col("c.last") - F.col("c.first") + 1 >= MIN_LINES)
    each = each.select("doc_id", "_text", "pos", _chunk_text(F.col("c")).alias("chunk")).where(F.length(F.trim(F.translate("chunk", "\n\r\t", ""))) > 0)
    return _repeats(each)


def _repeats(each: DataFrame) -> DataFrame:
    """doc_id, _text and _gone: every pos of a document whose chunk, compared as bytes, occurs at an earlier place; written."""
    each = each.withColumn("key", F.xxhash64("chunk"))
    keys = written(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "chunk-keys")
    again = written(each.join(_few(keys), "key", "left_semi").select("key", "chunk", "doc_id", "_text", "pos"), "chunks")
    place = F.struct("doc_id", "_text", "pos")
    firsts = again.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    # written, so that the join has two plain exchanges and Spark can split a passage with a large share
    firsts = written(firsts.select(F.col("key").alias("_key"), F.col("chunk").alias("_chunk"), "first"), "chunk-firsts")
    matched = again.join(firsts, (F.col("key") == F.col("_key")) & (F.col("chunk") == F.col("_chunk")))
    out = written(matched.where(place > F.col("first")).groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("_gone")), "chunks-gone")
    discard(keys, again, firsts)
    return out


def remove_repeated_chunks(docs: DataFrame, counts: tuple[str, str] = ("n_removed", "removed_chars")) -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and two counts: chunks and characters removed.

    Null and empty texts and texts of one line stay as they are. Rows that agree in doc_id
    and text are one document: they keep and lose the same chunks. Of a text all of whose
    chunks go, the empty string is left. Columns named like the counts are replaced; others
    may have any names. An empty table gives an empty result.
    """
    gone = _few(repeated_chunks(docs).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash"), "_gone"))
    joined = _plain(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")) & F.contains("text", F.lit("\n")), "left")
    chunked = with_chunks(joined, F.col("_gone").isNotNull())
    stay = F.filter("_chunks", lambda c, i: ~F.array_contains(F.col("_gone"), i))
    rest = _held(chunked, "_new", F.coalesce(F.array_join(F.transform(stay, _chunk_text), "\n"), F.col("text")))
    return _named(rest, docs.columns, counts, F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")))


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, _text and _gone: the numbers of the lines that, with the line behind them, occur at an earlier place; written."""
    several = docs.select("doc_id", "text").where(F.contains("text", F.lit("\n"))).withColumn("_text", F.xxhash64("text"))
    lines = _held(several.select("doc_id", "_text", "text"), "_lines", F.split("text", "\n", -1)).drop("text")
    pairs = F.zip_with(F.slice("_lines", F.lit(1), F.size("_lines") - 1), F.slice("_lines", F.lit(2), F.size("_lines") - 1), lambda a, b: F.concat(a, F.lit("\n"), b))
    return _repeats(lines.select("doc_id", "_text", F.posexplode(pairs).alias("pos", "chunk")))


def remove_repeated_passages(docs: DataFrame, counts: tuple[str, str] = ("n_removed", "removed_chars")) -> DataFrame:
    """``docs`` with repeated multi-line passages of any place taken out of ``text``, and two counts: passages and characters removed.

    Two neighbouring lines repeat if they are neighbours, in this order, at an earlier place by
    (doc_id, line number). Lines joined by such pairs are a passage; it goes whole unless it is
    all blank. Whatever stands around it, every repeated passage of two lines or more is thus
    covered, repeated chunks among them; the first place of each distinct line stays. Nulls,
    texts of one line, repeated rows and columns are treated as by ``remove_repeated_chunks``.
    """
    gone = _few(repeated_pairs(docs).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_hash"), F.array_sort("_gone").alias("_gone")))
    joined = _plain(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash")) & F.contains("text", F.lit("\n")), "left")
    g = F.col("_gone")
    out = _held(joined, "_lines", F.when(g.isNotNull(), F.split("text", "\n", -1)))
    first = F.filter(g, lambda x, k: F.coalesce(F.get(g, k - 1) != x - 1, F.lit(True)))
    last = F.transform(F.filter(g, lambda x, k: F.coalesce(F.get(g, k + 1) != x + 1, F.lit(True))), lambda x: x + 1)
    out = _held(out, "_runs", F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))
    out = _held(out, "_goes", F.filter("_runs", lambda c: F.length(F.trim(F.translate(_chunk_text(c), "\n\r\t", ""))) > 0))
    r = F.col("_goes")
    # what stands before each passage, and behind the last
    between = F.transform(F.concat(r, F.array(F.struct(F.size("_lines").alias("first"), F.size("_lines").alias("last")))), lambda c, k: F.struct(F.coalesce(F.get(r, k - 1)["last"] + 1, F.lit(0)).alias("first"), (c["first"] - 1).alias("last")))
    out = _held(out, "_stay", F.filter(between, lambda c: c["first"] <= c["last"]))
    rest = _held(out, "_new", F.coalesce(F.array_join(F.transform("_stay", _chunk_text), "\n"), F.col("text")))
    return _named(rest, docs.columns, counts, F.when(r.isNull(), 0).otherwise(F.size(r)))


#: The same in DuckDB, for rows of documents whose doc_id is unique.
ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i,
         len(string_split(text, chr(10))) AS n
  FROM documents WHERE text IS NOT NULL
), rolled AS (
  SELECT *, md5(coalesce(md5(lag(line) OVER (PARTITION BY doc_id ORDER BY i)), '') || md5(line)) AS r FROM lines
), ended AS (
  SELECT *, CASE WHEN i = n - 1 OR (i > 0 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i)
                                    AND r < lead(r) OVER (PARTITION BY doc_id ORDER BY i)) THEN 1 ELSE 0 END AS e FROM rolled
), placed AS (
  SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM ended
), chunks AS (
  SELECT doc_id, pos, count(*) AS k, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, pos
), marked AS (
  SELECT *, CASE WHEN k >= 2 AND length(trim(translate(chunk, chr(10) || chr(13) || chr(9), ''))) > 0
                 THEN row_number() OVER (PARTITION BY chunk, k >= 2 ORDER BY doc_id, pos) ELSE 1 END AS rn FROM chunks
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE rn > 1) AS n_removed,
         coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE rn = 1), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, k.text, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
       CAST(coalesce(length(d.text), 0) - coalesce(length(k.text), 0) AS INTEGER) AS removed_chars
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
