"""Each operator against a brute-force version or its SQL, on real rows and on awkward ones."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticklake.llm import decontamination, filters, line_dedup, near_dup, piece_encoding, quality, sharding, suffix_dedup, token_counts
from ticklake.llm import queries as registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 701} and{i % 13}" for i in range(40_000))
PASSAGE = " ".join(f"passage{i}" for i in range(90))
TEXTS = [
    None, "", " ", "\n\n", "a", "one two three four five six", "one two three four five six", "One Two  three\tfour five six", LONG, LONG + " end",
    "a shared line of text\nand another\n  A SHARED line of text \nlast", "a shared line of text", "käse straße 北京   x\x00y  z 🙂🙂",
    "start " + PASSAGE + " end", PASSAGE + " other tail", "x " * 300, "# $ % & | < >", "tab\x0bvt\x0cff\rcr", "short", "short", "ünïcödé line that is long enough\nünïcödé LINE that is long enough",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "hot" if i % 3 else None, len(t or "")) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def clashing(spark, odd):
    names = ["id", "key", "row", "th", "a", "b", "n", "shard", "slot", "score", "node", "component", "line", "host", "at", "predicted"]
    return odd.withColumns({c: F.lit("x") for c in names})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


# sharding


def test_shards(odd, clashing, empty):
    rows = sharding.shuffle_shards(odd, 4, bucket_bytes=50_000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(enumerate(TEXTS))
    for shard, n in Counter(r.shard for r in rows).items():
        assert n in (len(TEXTS) // 4, -(-len(TEXTS) // 4))
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    again = sharding.shuffle_shards(odd.repartition(3), 4, bucket_bytes=50_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert sharding.shuffle_shards(clashing, 4).count() == len(TEXTS)
    assert sharding.shuffle_shards(empty, 4).count() == 0
    twice = sharding.shuffle_shards(odd.unionAll(odd), 3).collect()
    assert sorted(Counter(r.shard for r in twice).values()) == [len(TEXTS) * 2 // 3] * 3


def test_shards_of_copies_and_of_order(spark):
    copies = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("same " * 200).alias("text")).repartition(4)
    rows = sharding.shuffle_shards(copies, 8, bucket_bytes=100_000)
    assert rows.count() == 4000 and Counter(r.shard for r in rows.collect()) == Counter({k: 500 for k in range(8)})
    buckets = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(buckets) > 30 and max(r["count"] for r in buckets) < 200
    # over many seeds a row is in each place about as often
    few = spark.range(12).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1)
    places = Counter((r.doc_id, r.slot) for seed in range(60) for r in sharding.shuffle_shards(few, 1, seed=seed, bucket_bytes=60).collect())
    expected = 60 / 12
    assert sum((places[i, k] - expected) ** 2 / expected for i in range(12) for k in range(12)) < 121 + 4 * (2 * 121) ** 0.5


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TEXTS)


def test_op1_columns(spark, sf_dir):
    out = registry.queries()["op1_shuffle_shards"](spark, sf_dir)
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in out.collect():
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


# repeated strings


def brute_spans(texts):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()


def suffix_case(texts):
    return {(i, *x) for i, x in enumerate(brute_spans(texts))}


def test_repeated_strings(spark, clashing, empty):
    import random

    rnd = random.Random(5)
    piece = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    a, b = piece(900), piece(450)
    texts = [None, "", a, "x" + a + "y", a[:399], a[1:400], a[200:700] + b, b + b, b[3:440] + piece(30), "z" * 1000, "z" * 399, "zq" * 300, piece(2000), a[100:520] + piece(300) + b[7:430], a, None]
    texts += [piece(rnd.randrange(300)) + a[(k := rnd.randrange(400)) : k + rnd.randrange(380, 480)] + piece(rnd.randrange(300)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {tuple(r) for r in suffix_dedup.remove_repeated(df).collect()}
    assert got == suffix_case(texts)
    assert suffix_dedup.remove_repeated(clashing.where("doc_id not in (8, 9)")).count() == len(TEXTS) - 2
    assert suffix_dedup.remove_repeated(empty).count() == 0


@pytest.mark.parametrize("way", ["one filter", "ranges", "digests"])
def test_repeated_strings_of_long_texts_null_keys_and_repeated_rows(spark, monkeypatch, way):
    import random

    if way == "ranges":
        monkeypatch.setattr(suffix_dedup, "fits", lambda keys: False)
        monkeypatch.setattr(filters, "RANGE", 256)
    if way == "digests":
        monkeypatch.setattr(suffix_dedup, "MOST", 2)
    rnd = random.Random(8)
    piece = lambda n: "".join(rnd.choices("abcdefgh \n", k=n))
    a, long = piece(1200), piece(560_000)  # a row of several parts; strings across their border repeat too
    texts = [long, piece(50) + long[523_000:525_500] + piece(50), a, "é" + a[5:900], None, "", piece(3000)]
    texts += [piece(rnd.randrange(200)) + a[(k := rnd.randrange(500)) : k + rnd.randrange(390, 600)] + piece(rnd.randrange(200)) for _ in range(12)]
    keys = [None if i % 4 == 1 else i for i in range(len(texts))]
    rows = list(zip(keys, texts))
    rows += [rows[6], rows[1], rows[4]]  # whole texts that repeat
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_spans([t for _, t in rows])))


def test_repeated_strings_of_real_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {tuple(r) for r in registry.queries()["op2_suffix_dedup"](spark, sf_dir).collect()}
    assert got == {(r.doc_id, *x) for r, x in zip(rows, brute_spans([r.text for r in rows]))}


def test_suffix_array_order():
    import random

    from ticklake.llm.suffix_array import suffix_array

    rnd = random.Random(3)
    for n in [*range(1, 30), 400]:
        for alphabet in (1, 2, 5, 60):
            s = [rnd.randrange(1, alphabet + 1) for _ in range(n)] + [0]
            assert suffix_array(s) == sorted(range(n + 1), key=lambda i: s[i:])


# token counts


def test_token_lengths(spark, odd, empty):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode = token_counts._encoder(path, pattern).encode_ordinary
    lengths = Counter(len(encode(t)) if t else 0 for t in TEXTS)
    hist = token_counts.length_histogram(token_counts.encoded_lengths(odd, path, pattern))
    total = sum(k * n for k, n in lengths.items())
    for r in hist.collect():
        k = r.n_tokens
        assert r.n_docs == lengths[k]
        assert r.docs_from == sum(n for x, n in lengths.items() if x >= k)
        assert r.tokens_from == sum(x * n for x, n in lengths.items() if x >= k)
        assert r.truncated_total == sum(min(x, k) * n for x, n in lengths.items())
        assert r.quantile == pytest.approx(sum(n for x, n in lengths.items() if x <= k) / len(TEXTS))
    for r in token_counts.limit_report(hist, [0, 7, 100, 10**9]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) * n for x, n in lengths.items())
        assert r.tokens_cut == total - r.truncated_total
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty, path, pattern)).count() == 0


# benchmark items


def test_contained_items(spark, odd, clashing, empty, oracle, rows_of):
    items = spark.createDataFrame([(1, PASSAGE), (2, "one two three four five six"), (3, None), (4, ""), (5, "short"), (6, PASSAGE.replace("passage3 ", "other ")), (7, "never seen here at all now"), (2, "SHORT")], "item_id long, text string")
    got = decontamination.contained_items(odd, items)
    brute = Counter()
    for r in items.collect():
        a = decontamination.exact_shingles(r.text)
        for i, t in enumerate(TEXTS):
            common = len(a & decontamination.exact_shingles(t))
            if a and common >= 0.8 * len(a) - 1e-9:
                brute[i, r.item_id, len(a), common] += 1
    assert Counter(tuple(r)[:4] for r in got.collect()) == brute and brute
    assert Counter(tuple(r)[:4] for r in decontamination.contained_items(odd, items, block_bytes=300).collect()) == brute
    gone = {k[0] for k in brute}
    assert {r.doc_id for r in decontamination.without_items(clashing, items).collect()} == set(range(len(TEXTS))) - gone
    assert decontamination.contained_items(empty, items).count() == 0 == decontamination.contained_items(odd, items.where("false")).count()


# pieces


def test_pieces_match_the_library(odd, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in piece_encoding.encode_texts(odd, path, keep_ids=True, keep_decoded=True).collect():
        ids = sp.encode(TEXTS[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded == sp.decode(ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert piece_encoding.encode_texts(empty, path).count() == 0


# SQL for the operators that have it


@pytest.mark.parametrize("name", ["op6_decontamination", "op8_quality", "op9_line_dedup"])
def test_queries_equal_sql(name, spark, sf_dir, oracle, rows_of):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == oracle(registry.oracle_sql()[name], sf_dir)


def test_quality_of_odd_texts(odd, clashing, empty, oracle, rows_of):
    got = quality.judge(odd, limit=20).drop("removed")
    assert rows_of(got) == oracle(quality.ORACLE, {"documents": odd})
    assert quality.judge(clashing).count() == len(TEXTS) and quality.judge(empty).count() == 0
    copies = odd
    for _ in range(5):
        copies = copies.unionAll(copies)
    once = Counter(tuple(r) for r in got.collect())  # 32 rows of one document aren't 32 documents
    assert Counter(tuple(r) for r in quality.judge(copies).drop("removed").collect()) == Counter({r: 32 for r in once})


def test_frequent_lines_reject(spark):
    body = "a line that every page of the host repeats\n"
    rows = [(i, body + f"own words of page number {'x' * i}", "en", "h" if i < 30 else "g", 1) for i in range(40)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS), limit=20, most=0.4).collect()}
    assert [k for k, v in got.items() if v and k < 14] == [] and all(got[i] for i in range(30, 40))
    cut = {r.doc_id: r.text for r in quality.without_frequent_lines(spark.createDataFrame(rows, DOCS).withColumn("gone", F.lit("x")), limit=20, most=0.4).collect()}
    assert cut.keys() == {i for i, *_ in rows if i >= 30 or len(body) - 1 <= 0.4 * (len(rows[i][1]) - 1)}
    assert all(t == (rows[i][1][len(body) :] if i < 30 else rows[i][1]) for i, t in cut.items())


def test_lines_of_odd_texts(odd, clashing, empty, oracle, rows_of):
    got = line_dedup.dedup_lines(odd.select("doc_id", "text"), bits=1 << 20)
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    assert rows_of(got) == oracle(line_dedup.ORACLE, {"documents": odd})
    assert line_dedup.dedup_lines(clashing, bits=1 << 20).count() == len(TEXTS)
    assert line_dedup.dedup_lines(empty, bits=1 << 20).count() == 0


def test_lines_of_a_full_filter_and_of_few_told_lines(odd, rows_of):
    roomy, full, few = (line_dedup.dedup_lines(odd, **x) for x in ({"bits": 1 << 24}, {"bits": 1 << 19}, {"hot": 1}))
    assert rows_of(full) == rows_of(roomy) == rows_of(few)


def test_ranges_of_filters_let_few_single_keys_through(spark, monkeypatch):
    monkeypatch.setattr(filters, "MOST_BITS", 1 << 20)
    monkeypatch.setattr(filters, "RANGE", 1 << 14)
    n = 200_000
    assert not filters.fits(n) and filters.fits(1 << 16)
    row = F.col("id")
    # every 50th key twice, far apart; one key in a third of all rows; the others once
    key = F.when(row % 3 == 0, -1).when((row >= n) & (row % 50 == 1), row - n).otherwise(row)
    rows = spark.range(2 * n).select(F.col("id"), F.xxhash64(key).alias("h")).repartition(7)
    got = filters.screened(rows, lambda batch: batch.column("h").to_numpy(), 2 * n).groupBy("h").agg(F.count(F.lit(1)).alias("n")).collect()
    every = {r.h: r["count"] for r in rows.groupBy("h").count().collect()}
    found = {r.h: r.n for r in got}
    repeated = {h for h, k in every.items() if k > 1}
    assert all(found[h] == every[h] for h in repeated) and len(repeated) > 1000
    assert len(found.keys() - repeated) < 0.02 * (len(every) - len(repeated))


def test_lines_by_ranges_of_filters(spark, odd, sf_dir, monkeypatch, rows_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = rows_of(line_dedup.dedup_lines(docs))
    monkeypatch.setattr(line_dedup, "fits", lambda keys: False)
    monkeypatch.setattr(filters, "RANGE", 128)
    assert rows_of(line_dedup.dedup_lines(docs)) == want
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_lines_of_repeated_rows_and_null_keys(spark, sf_dir):
    real = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    rows = [(i % 150 if i % 11 else None, t) for i, t in enumerate(real)]
    rows += rows[:60]
    holders = {}
    for i, t in rows:
        for k in {line_dedup.line_key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add((i is None, i or 0))
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(k := line_dedup.line_key(x)) < 10 or min(holders[k]) == (i is None, i or 0) or len(holders[k]) == 1]
        want[i, len(lines), len(lines) - len(stay), t if len(stay) == len(lines) else "\n".join(stay)] += 1
    for hot in (3, 1 << 17):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot)
        assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == want


# near duplicates


def brute_components(rows, percent=85):
    sets = {i: decontamination.exact_shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    own = [i for i in sets if sets[i]]
    for k, i in enumerate(own):
        for j in own[k + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_of_odd_texts(odd, clashing, empty):
    assert {tuple(r) for r in near_dup.near_duplicates(odd).collect()} == brute_components(enumerate(TEXTS))
    assert near_dup.near_duplicates(clashing).count() == len(TEXTS)
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_real_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in registry.queries()["op10_near_dup"](spark, sf_dir).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("block", [2000, 25])
def test_large_groups_stay_whole(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(near_dup, "BLOCK", block)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i in range(300) for k in [rnd.randrange(200)]]
    rows += [(1000 + i, " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 300} == {0} and sum(r.kept for r in got) == 201


def test_near_duplicates_of_repeated_rows_and_null_keys(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(5, words), (5, words), (None, words), (9, words + " more"), (9, words + " more"), (None, "alone in its set of words"), (None, None), (7, "other text of its own here"), (3, None), (3, None)]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    assert got == {(5, 5, True): 2, (None, 5, False): 1, (9, 5, False): 2, (None, None, True): 2, (7, 7, True): 1, (3, 3, True): 2}
