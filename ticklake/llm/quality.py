"""Quality rules on DataFrame functions alone: word, symbol and repetition counts of each text, and
cross-document line frequency.

Lines are normalised (trimmed, lowered, digit runs as 0) and hashed; for each host (``source``) the
different documents that hold a line are counted. Lines over the limit are boilerplate of their host
and are removed; a document that loses more than its share of characters this way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACE_CLASS, table, written

LINE_LIMIT, MOST_REMOVED = 20, 0.5


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE_BYTES.decode()))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def base_signals(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) and
    base_failed. Null and empty texts have no words and fail."""
    t = F.coalesce(F.col(text), F.lit(""))
    own = docs.columns
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_BYTES.decode())) != "")
    df = docs.withColumns({"__words": _words(t), "__lines": lines, "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long")})
    df = df.select(
        *own, "n_symbols", F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    window = "transform(sequence(0, size(__hashes) - 5), i -> xxhash64(__hashes[i], __hashes[i + 1], __hashes[i + 2], __hashes[i + 3], __hashes[i + 4]))"
    df = df.withColumn("__windows", F.when(F.size("__hashes") >= 5, F.expr(window)))
    # most texts repeat no window; only the others are sorted to find which
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    df = df.withColumn("__sorted", F.when(repeats, F.expr("sort_array(transform(__windows, (h, i) -> struct(h, i)))")))
    places = F.expr("sort_array(transform(filter(transform(__sorted, (s, k) -> struct(s.i as i, coalesce(get(__sorted, k - 1).h = s.h, false) or coalesce(get(__sorted, k + 1).h = s.h, false) as again)), x -> x.again), x -> x.i))")
    df = df.withColumn("__places", F.when(F.col("__sorted").isNotNull(), places))
    covered = F.expr("aggregate(__places, named_struct('n', 0, 'last', -5), (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p), a -> a.n)")
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__places").isNotNull(), covered), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _lines(text: Column) -> Column:
    """(line, h, g, chars) of each line with a word; h and g hash its normal form."""
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SPACE_BYTES.decode())), "[0-9]+", "0"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_BYTES.decode())) != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(norm(x)).alias("h"), F.hash(norm(x)).alias("g"), F.length(x).alias("chars")))


def _identity(key: str, text: str, host: str) -> list[Column]:
    return [F.col(key).alias("__key"), F.xxhash64(text).alias("__th"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("__host")]


def frequent_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """(host, h, g): lines by hash that more than ``limit`` different documents (keys) of a host hold."""
    rows = docs.select(*_identity(key, text, host), _lines(F.col(text)).alias("lines"))
    own = F.array_distinct(F.transform("lines", lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"))))
    held = rows.select("__key", F.col("__host").alias("host"), F.explode(own).alias("line")).groupBy("host", "line.h", "line.g")
    return held.agg(F.count_distinct("__key").alias("docs")).where(F.col("docs") > limit).select("host", "h", "g")


def removed_share(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LINE_LIMIT, lines: bool = False) -> DataFrame:
    """(__key, __th, __host, ``removed``): the share of a text's line characters in lines that more than
    ``limit`` documents of its host hold, and on request these lines' hashes (``gone``); no row for
    texts without lines. Rows with one key, text and host are one."""
    # written, so that both sides of the join are dealt anew and Spark can split a common line
    frequent = written(frequent_lines(docs, key=key, text=text, host=host, limit=limit), "frequent").withColumn("frequent", F.lit(True))
    every = docs.select(*_identity(key, text, host), F.explode(_lines(F.col(text))).alias("line")).select("*", "line.*")
    marked = every.join(frequent, (F.col("__host") == F.col("host")) & (every["h"] == frequent["h"]) & (every["g"] == frequent["g"]), "left")
    sums = [F.sum(F.when(F.col("frequent"), F.col("chars")).otherwise(0)).alias("lost"), F.sum("chars").alias("all")]
    gone = [F.collect_set(F.when(F.col("frequent"), F.struct(every["h"], every["g"]))).alias("gone")] * lines
    out = marked.groupBy("__key", "__th", "__host").agg(*sums, *gone)
    return out.select("__key", "__th", "__host", (F.col("lost") / F.col("all")).alias("removed"), *["gone"] * lines)


def _attached(rows: DataFrame, rest: DataFrame) -> DataFrame:
    rest = rest.withColumnsRenamed({"__key": "__k", "__th": "__t", "__host": "__h"})
    same = rows["__key"].eqNullSafe(rest["__k"]) & (rows["__th"] == rest["__t"]) & (rows["__host"] == rest["__h"])
    return rows.join(rest, same, "left").withColumn("removed", F.coalesce("removed", F.lit(0.0))).drop("__k", "__t", "__h")


def without_frequent_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LINE_LIMIT, most: float = MOST_REMOVED) -> DataFrame:
    """The rows of ``docs`` that lose at most ``most`` of their line characters, without their host's
    frequent lines; the other lines stay as they are, lines without words too. Texts without lines
    (null, empty) stay. Hosts and keys can be null; rows equal in key, text and host stay as often
    as they come."""
    rest = written(removed_share(docs, key=key, text=text, host=host, limit=limit, lines=True), "removed")
    rows = _attached(docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).cast("string").alias("__text"), *_identity(key, text, host)), rest)
    split = F.split("__text", "\n", -1)
    norm = lambda x: F.lower(F.regexp_replace(F.btrim(x, F.lit(SPACE_BYTES.decode())), "[0-9]+", "0"))
    stays = F.filter(split, lambda x: (F.btrim(x, F.lit(SPACE_BYTES.decode())) == "") | ~F.array_contains("gone", F.struct(F.xxhash64(norm(x)).alias("h"), F.hash(norm(x)).alias("g"))))
    cut = F.when(F.size("gone") > 0, F.array_join(stays, "\n")).otherwise(F.col("__text"))
    return rows.where(F.col("removed") <= most).select("__row", cut.alias("__cut")).select(*[F.col("__cut").alias(c) if c == text else F.col("__row")[c].alias(c) for c in docs.columns])


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", limit: int = LINE_LIMIT, most: float = MOST_REMOVED) -> DataFrame:
    """One row for each row of ``docs``: key, the base signals, ``base_failed``, ``removed`` and
    ``kept``: not base_failed, and at most ``most`` of the text's line characters removed. A null host
    is a host of its own; null keys are allowed, but count as no document in a line's count. A document
    in several rows counts once. Other columns, of whatever name, don't matter."""
    rest = written(removed_share(docs, key=key, text=text, host=host, limit=limit), "removed")
    rows = base_signals(docs.select(*_identity(key, text, host), F.col(text).cast("string").alias("__text")), text="__text").drop("__text")
    out = _attached(rows, rest)
    kept = ~F.col("base_failed") & (F.col("removed") <= most)
    return out.select(F.col("__key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "removed")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("removed")


ORACLE = r"""
with d as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents
), word as (
  select doc_id, unnest(range(len(ws))) as i, unnest(ws) as w from d where len(ws) >= 5
), win as (
  select doc_id, i, concat_ws(' ', w, lead(w, 1) over t, lead(w, 2) over t, lead(w, 3) over t, lead(w, 4) over t) as w from word window t as (partition by doc_id order by i) qualify lead(w, 4) over t is not null
), rep as (
  select doc_id, i, count(*) over (partition by doc_id, w) as n from win
), cov as (
  select doc_id, least(5, i - coalesce(lag(i) over (partition by doc_id order by i), -5)) as c from rep where n > 1
), r as (select doc_id, sum(c) as n_repeat_words from cov group by doc_id
), l as (
  select doc_id, host, length(line) as chars, lower(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[0-9]+', '0', 'g')) as k from (select doc_id, host, unnest(lines) as line from d)
), f as (select host, k from l group by host, k having count(distinct doc_id) > 20
), g as (select l.doc_id, sum(case when f.k is not null then chars else 0 end) / sum(chars) as removed from l left join f on f.host = l.host and f.k = l.k group by l.doc_id
), b as (
  select d.doc_id, len(ws) as n_words, coalesce(length(array_to_string(ws, '')), 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(removed, 0) as removed
  from d left join r using (doc_id) left join g using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and removed <= 0.5 as kept from b
"""
