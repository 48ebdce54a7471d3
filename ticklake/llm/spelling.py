"""Spelling variants: words at distance one, by a trie that is joined with itself.

A vocabulary's trie is walked level by level. Beside each node go the nodes of the same subtrie that
are one insertion or replacement away (its active nodes); a pair of nodes at distance one passes to
those of their children that have equal letters, and words that end at both are near. A pair starts
only where its words part, at one node, so each pair of words is met once.

The trie is cut by prefixes so that every part has few words: a prefix that more than ``MOST`` words
share is cut further down. Words that part above the cut are one apart there already, so their rests
must be equal: an active pair crosses the cut as (the node where they part, the rest), which is a
grouping of at most one word a letter, and one more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table, written

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Words of one part of the trie at most, words whose parts a task walks together, words a task counts before it sends them on,
#: and shared prefixes that tasks are told of (more are joined by shuffle).
MOST, TOGETHER, COUNTED, TOLD = 4_000, 16_000, 200_000, 100_000
#: Letters of words (fixed values), of which every 199th run in a document loses one.
LETTERS = "a-zÀ-ÿ"
LOST = 199
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Depths at which the trie may be cut: each half as deep again as the one before, so that all prefixes of a word to be counted are a few times its length.
DEPTHS = [1, 2, 3, *(k << e for e in range(1, 29) for k in (2, 3))]
PAIRS = "word_a string, n_a long, word_b string, n_b long"


def word_counts(df: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n``: the runs of letters of all whole texts with A-Z lowered, one letter less where
    the checksum of key and run says so, of at least so many code points and occurrences. Null texts
    have none; a null key is an empty one; repeated rows count again; other columns don't matter.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in pieces(batches):
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                start = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(run_of.findall(text.translate(_LOWER) if text else "")).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % LOST == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    total[word] += n
                if len(total) > COUNTED:
                    yield sent()
        yield sent()

    found = df.select(F.col(key).cast("string"), F.col(text).cast("string").alias("__text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def with_cuts(words: DataFrame, most: int = MOST) -> DataFrame:
    """``cut`` beside word and n: the depth at which the word's part of the trie begins, the first whose
    prefix at most ``most`` words share; a depth beyond the word's end where there is none."""
    if words.count() <= most:
        return words.withColumn("cut", F.lit(0))
    depths = F.array(*map(F.lit, DEPTHS))
    prefixes = words.select("word", F.explode(F.filter(depths, lambda d: d <= F.length("word"))).alias("depth"))
    prefixes = prefixes.withColumn("prefix", F.expr("substring(word, 1, depth)"))
    shared = written(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("prefix"), "prefixes")
    if shared.count() <= TOLD:
        on, shared = ["prefix"], F.broadcast(shared)
    else:  # each of them is a hot key by what it is
        on, salts = ["prefix", "salt"], F.lit(64)
        prefixes = prefixes.withColumn("salt", F.pmod(F.xxhash64("word"), salts).cast("int"))
        shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    deepest = prefixes.join(shared, on, "left_semi").groupBy("word").agg(F.max("depth").alias("depth"))
    after = F.element_at(depths, (F.array_position(depths, F.coalesce("depth", F.lit(0))) + 1).cast("int"))
    return words.join(deepest, "word", "left").select("word", "n", after.alias("cut"))


def _texts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each begins."""
    ends = np.cumsum([0, *map(len, words)])
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), ends


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of runs of numbers, and of which run each is."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class Level:
    """The nodes of one depth below the cuts: each one's parent, letter, first child and number of
    children (on the next level), and the word that ends there, if any. Siblings lie side by side."""

    def __init__(self, parent: np.ndarray, letter: np.ndarray, ending: np.ndarray) -> None:
        self.key = parent << 21 | letter  # ascending
        self.letter, self.ending = letter, ending
        self.first = self.count = np.zeros(len(ending), np.int64)

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _spread(self.first[nodes], self.count[nodes])


def _find(level: Level, parents: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The child of each parent with this letter, or -1."""
    if not len(level.key):
        return np.full(len(parents), -1)
    wanted = parents << 21 | letters
    at = np.minimum(np.searchsorted(level.key, wanted), len(level.key) - 1)
    return np.where(level.key[at] == wanted, at, -1)


def near_pairs(words: list[str], roots: list[int], depths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of distinct words at distance one with the same root that part at or below
    its depth. Words of a root lie side by side in code-point order, each at least as long as the depth."""
    letters, begin = _texts(words)
    size = np.diff(begin)
    root, depth = np.asarray(roots, np.int64), np.asarray(depths, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def ending_of(node: np.ndarray, alive: np.ndarray, at: int, n: int) -> np.ndarray:
        out = np.full(n, -1)
        over = size[alive] == depth[alive] + at
        out[node[over]] = alive[over]
        return out

    def grown(level: Level, node: np.ndarray, alive: np.ndarray, at: int) -> tuple[Level, np.ndarray, np.ndarray]:
        """The next level, and the words that reach it with their nodes."""
        on = size[alive] > depth[alive] + at
        node, alive = node[on], alive[on]
        letter = letters[begin[alive] + depth[alive] + at]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        child = np.cumsum(new) - 1
        below = Level(node[new], letter[new], ending_of(child, alive, at + 1, int(new.sum())))
        level.count = np.bincount(node[new], minlength=len(level.ending))
        level.first = np.cumsum(level.count) - level.count
        return below, child, alive

    def met(a: np.ndarray, b: np.ndarray) -> None:
        both = (a >= 0) & (b >= 0)
        if both.any():
            found.append((a[both], b[both]))

    def passed(x_level: Level, x_below: Level, x: np.ndarray, y_below: Level, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of both nodes of each pair by equal letters."""
        child, of = x_level.children(x)
        other = _find(y_below, y[of], x_below.letter[child])
        return child[other >= 0], other[other >= 0]

    start = np.concatenate([[True], root[1:] != root[:-1]])
    node, upper = np.cumsum(start) - 1, np.arange(len(words))
    here = Level(node[start], np.zeros(int(start.sum()), np.int64), ending_of(node, upper, 0, int(start.sum())))
    below, node, lower = grown(here, node, upper, 0)
    none = np.zeros(0, np.int64)
    # pairs at distance one: of two nodes of this level, and of a node below and one of this level
    replaced, inserted, at = (none, none), (none, none), 0
    while len(below.ending):
        if len(upper) == len(here.ending):  # every node has one word: nothing parts any more, rests decide
            for (x, y), of_x, further in ((replaced, upper, 0), (inserted, lower, 1)):
                rests = [(a, b) for a, b in zip(of_x[x].tolist(), upper[y].tolist()) if (rest := words[a][depths[a] + at + further :]) and rest == words[b][depths[b] + at :]]
                if rests:
                    found.append(tuple(np.array(rests).T))
            break
        after, node, lowest = grown(below, node, lower, at + 1)
        x, y = passed(here, below, replaced[0], below, replaced[1])
        longer, shorter = passed(below, after, inserted[0], below, inserted[1])
        # words part at a node of this level: into two of its children; into a child's child and its
        # child of that letter; into a child and the word that the node ends
        parent = below.key >> 21
        order = np.arange(len(parent))
        sibling, of = _spread(order + 1, here.first[parent] + here.count[parent] - order - 1)
        child, over = below.children(order)
        twin = _find(below, parent[over], after.letter[child])
        new = (twin >= 0) & (after.letter[child] != below.letter[over])
        met(below.ending, here.ending[parent])
        replaced = np.concatenate([x, of]), np.concatenate([y, sibling])
        inserted = np.concatenate([longer, child[new]]), np.concatenate([shorter, twin[new]])
        met(below.ending[replaced[0]], below.ending[replaced[1]])
        met(after.ending[inserted[0]], below.ending[inserted[1]])
        here, below, upper, lower, at = below, after, lower, lowest, at + 1
    if not found:
        return none, none
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pairs_below_cuts(words: DataFrame) -> DataFrame:
    """Near words that part at or below their cut: whole parts of the trie go to a task, some at a time."""
    rows = words.where(F.length("word") >= F.col("cut")).select(F.expr("substring(word, 1, cut)").alias("root"), "cut", "word", "n")

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.Table.from_batches(held)
        names, numbers = part["word"].combine_chunks(), part["n"].combine_chunks()
        root = part["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = (pa.array(x) for x in near_pairs(names.to_pylist(), root, part["cut"].to_pylist()))
        return pa.RecordBatch.from_arrays([names.take(a), numbers.take(a), names.take(b), numbers.take(b)], ["word_a", "n_a", "word_b", "n_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            root = batch.column(0).dictionary_encode().indices.to_numpy()
            last = int(np.searchsorted(root, root[-1]))  # where the batch's last root begins
            goes_on = held and held[-1].column(0)[-1] == batch.column(0)[0]
            if size >= TOGETHER and not goes_on:
                yield pairs(held)
                held, size = [], 0
            if size + last >= TOGETHER and last:
                yield pairs([*held, batch.slice(0, last)])
                held, size, batch = [], 0, batch.slice(last)
            held.append(batch)
            size += batch.num_rows
        if held:
            yield pairs(held)

    return rows.repartition("root").sortWithinPartitions("root", "word").mapInArrow(run, PAIRS)


def pairs_across_cuts(words: DataFrame) -> DataFrame:
    """Near words that part above their cut: the same letters before, the same rest behind, and one letter
    or none between. A group has one word a letter, and the one without."""
    place = F.explode(F.sequence(F.lit(0), F.least(F.col("cut") - 1, F.length("word"))))
    rows = words.where("cut > 0").select("word", "n", place.alias("k"))
    before, rest = F.expr("substring(word, 1, k)"), lambda skip: F.expr(f"substring(word, k + {1 + skip})")
    letter = F.nullif(F.expr("substring(word, k + 1, 1)"), F.lit(""))
    with_letter = F.struct(F.concat_ws("|", before, rest(1)).alias("at"), letter.alias("letter"))
    without = F.struct(F.concat_ws("|", before, rest(0)).alias("at"), F.lit(None).cast("string").alias("letter"))
    both = F.when(letter.isNull(), F.array(without)).otherwise(F.array(with_letter, without))
    ways = rows.select("word", "n", F.explode(both).alias("way")).select("way.at", F.struct("way.letter", "word", "n").alias("member"))
    groups = ways.groupBy("at").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    pairs = groups.select("at", "members", F.explode("members").alias("a")).select("at", "a", F.explode("members").alias("b"))
    starts_rest = F.substring(F.substring_index("at", "|", -1), 1, 1)  # words without the letter go on with this one
    parted = F.col("b.letter").isNotNull() & F.when(F.col("a.letter").isNull(), F.col("b.letter") != starts_rest).otherwise(F.col("a.letter") < F.col("b.letter"))
    return pairs.where(parted).select(F.col("a.word").alias("word_a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("word_b"), F.col("b.n").alias("n_b"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """All pairs of distinct words (``word``, ``n``) that differ by exactly one inserted, deleted or
    replaced code point, each pair once: ``word_a``, ``n_a``, ``word_b``, ``n_b``. ``words`` must be
    distinct, without nulls, and come from a written table, as it's read more than once."""
    cut = written(with_cuts(words, most), "cut_words")
    return pairs_below_cuts(cut).unionByName(pairs_across_cuts(cut))


def with_roots(forms: DataFrame) -> DataFrame:
    """``root`` beside ``word`` and ``form``: the last of the forms that follow each other. Each round
    doubles how many are followed; counts grow with every form, so that there are few."""
    follow = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "forms")
    while True:
        on = follow.select(F.col("word").alias("root"), F.col("root").alias("further"))
        follow = written(follow.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if follow.where("moved").isEmpty():
            break
        follow = follow.select("word", "root")
    return forms.join(follow.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_forms(words: DataFrame, *, times: int = TIMES, most: int = MOST) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for distinct ``words`` (word, n). A
    word's form is its near word of largest n (of equals the smallest word), if that is at least
    ``times`` its own; its root is the last form that forms lead to, or itself."""
    words = written(words, "words")
    pair = lambda a, b: F.struct(F.col(f"word_{a}").alias("word"), F.col(f"word_{b}").alias("near"), F.col(f"n_{b}").alias("near_n"))
    near = near_words(words, most).select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    likelier = -F.col("best.less") >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(likelier, F.col("best.near")).alias("form"),
        F.when(likelier, -F.col("best.less")).alias("form_n"),
    )
    return with_roots(written(forms, "near_words")).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))


ORACLE = """with recursive bits(i, c, step) as (select i, i, 0 from range(256) r(i) union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, step + 1 from bits where step < 8),
  crc as (select list(c order by i) as t from bits where step = 8),
  runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
  said as (select run, count(*) as n, coalesce(doc_id::varchar, '') || ':' || run as name from runs where length(run) >= 6 group by all),
  coded as (select run, n, hex(encode(name)) as x from said),
  hashed as (select run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::bigint)), lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295) as h from coded, crc),
  words as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n from hashed group by 1 having length(word) >= 6 and sum(n) >= 5),
  gaps as (select word, n, substr(word, 1, k) as a, substr(word, k + 2) as b from words, unnest(range(length(word))) r(k)),
  shorter as (select distinct g.word as long, g.n as long_n, w.word as short, w.n as short_n from gaps g join words w on w.word = a || b),
  near as (select g.word, h.word as near, h.n as near_n from gaps g join gaps h on g.a = h.a and g.b = h.b and g.word <> h.word union all select long, short, short_n from shorter union all select short, long, long_n from shorter),
  best as (select word, count(*) as n_near, max(near_n) as most, min((-near_n, near))[2] as form from near group by 1),
  forms as (select word, n, coalesce(n_near, 0) as n_near, case when most >= 5 * n then form end as form, case when most >= 5 * n then most end as form_n from words left join best using (word)),
  ends(word, root) as (select word, word from forms union all select e.word, f.form from ends e join forms f on f.word = e.root where f.form is not null),
  roots as (select e.word, root from ends e join forms f on f.word = e.root where f.form is null)
  select word, form, root, n, n_near, form_n from forms join roots using (word)"""
