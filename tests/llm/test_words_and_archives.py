"""Spelling variants, token alignment and web archives, each against a plain version."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticklake.llm import queries as registry
from ticklake.llm import spelling, token_alignment, warc

FILES = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
NAMES = ["id", "key", "word", "n", "cut", "root", "links", "value", "content", "path", "refers_to", "__text", "url2"]


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_warc_archive"])
def test_queries_equal_sql(name, spark, sf_dir, oracle, rows_of):
    assert rows_of(registry.queries()[name](spark, sf_dir)) == oracle(registry.oracle_sql()[name], sf_dir)


# spelling


def near(u: str, v: str) -> bool:
    """One inserted, deleted or replaced code point: what is left after the common start and end."""
    u, v = sorted((u, v), key=len)
    k = next((k for k, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
    return u != v and (u[k + 1 :] if len(u) == len(v) else u[k:]) == v[k + 1 :] and len(v) - len(u) < 2


def near_by_pairs(words) -> set:
    return {(u, v) for u, v in combinations(sorted(words), 2) if near(u, v)}


def test_near_pairs_of_a_trie():
    rnd = random.Random(2)
    for _ in range(150):
        letters = "abcé"[: rnd.randrange(1, 5)]
        words = sorted({"".join(rnd.choices(letters, k=rnd.randrange(2, 8))) for _ in range(rnd.randrange(1, 60))})
        depth = rnd.randrange(3)
        roots = np.cumsum([0, *(a[:depth] != b[:depth] for a, b in zip(words, words[1:]))])
        got = [tuple(sorted((words[a], words[b]))) for a, b in zip(*spelling.near_pairs(words, roots, [depth] * len(words)))]
        assert len(got) == len(set(got)) and set(got) == {p for p in near_by_pairs(words) if p[0][:depth] == p[1][:depth]}
    long = sorted(["z" * 3000, "z" * 2999, "z" * 2998 + "y", "y" + "z" * 2999, "a" + "b" * 2000, "b" * 2000])
    got = {tuple(sorted((long[a], long[b]))) for a, b in zip(*spelling.near_pairs(long, [0] * 6, [0] * 6))}
    assert got == near_by_pairs(long)


@pytest.mark.parametrize(("most", "told"), [(1, 100_000), (7, 0), (50, 100_000), (4000, 0)])
def test_near_words_of_any_cut(spark, most, told, monkeypatch):
    """However finely the trie is cut, and whatever part of its words share a start."""
    monkeypatch.setattr(spelling, "TOLD", told)
    rnd = random.Random(most)
    words = {("hotstart" if rnd.random() < 0.4 else "") + "".join(rnd.choices("abé", k=rnd.randrange(1, 8))) for _ in range(300)}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [tuple(sorted((r.word_a, r.word_b))) for r in spelling.near_words(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_pairs(words)


def test_parts_of_the_trie_stay_small(spark):
    df = spark.createDataFrame([(f"same{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")), 5) for i in range(3000)], "word string, n long")
    cut = spelling.with_cuts(df, 40).where("length(word) >= cut")
    assert max(r["count"] for r in cut.groupBy(F.expr("substring(word, 1, cut)")).count().collect()) <= 40


def test_forms_and_roots(spark):
    # abcdef <- abcdex <- abcdyx: counts grow fivefold; ties go to the smaller word; abcdzz has no partner often enough
    counts = {"abcdef": 700, "abcdex": 130, "abcdyx": 6, "abcdyz": 5, "qqqqqa": 50, "qqqqqb": 50, "qqqqqc": 10, "lonely": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n_near, r.form_n) for r in spelling.spelling_forms(words).collect()}
    assert got["abcdyx"] == ("abcdex", "abcdef", 2, 130) and got["abcdex"] == ("abcdef", "abcdef", 2, 700)
    assert got["qqqqqc"] == ("qqqqqa", "qqqqqa", 2, 50) and got["qqqqqa"] == (None, "qqqqqa", 2, None)
    assert got["lonely"] == (None, "lonely", 0, None) and got["abcdyz"] == (None, "abcdyz", 1, None)
    assert spelling.spelling_forms(words.where("false")).count() == 0
    assert {r.n_near for r in spelling.spelling_forms(words.limit(1)).collect()} == {0}


def test_words_of_odd_texts(spark):
    texts = [(1, "Straße straßE STRASSE×÷x öffnen"), (2, None), (3, ""), (4, "z" * 60_000), (None, "without id"), (5, "naïve-naïve_naïve9naïvex"), (5, "naïve-naïve_naïve9naïvex")]
    texts += [(i, "wordly " * 3 + "a" * (i % 9)) for i in range(6, 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("x") for c in NAMES if c != "word"})
    want = Counter()
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
                run = ""
    want = {w: n for w, n in want.items() if len(w) >= 6}
    assert {r.word: r.n for r in spelling.word_counts(df, least_count=1).collect()} == want
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == {w: n for w, n in want.items() if n >= 5}
    assert spelling.word_counts(df.where("false")).count() == 0


# token alignment

TEXTS = [None, "", " ", "a", "  two  spaces ", "käse straße 北京大学 🙂🙂 x\x00y", "x▁y", "<|endoftext|> and </s> <0x41>", "\n\n\ttabs\r\n", "it's I'LL don't", "same", "same", "naïve café 1234567", "x" * 3000, "plain words, " * 4000]


def plain_alignment(texts):
    """Token by token, link by link."""
    a_side, b_side = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_side.encode_special_tokens = True
    table = {c: b for b, c in enumerate(_byte_characters())}
    rows, count, best = [], Counter(), Counter()
    for t in texts:
        whole = b" " + (t or "").encode()
        a = a_side.encode(" " + (t or ""), add_special_tokens=False)
        a = [(i, bytes(table[c] for c in x)) for i, x in zip(a.ids, a.tokens)]
        b = [(i, bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode()) for i in b_side.encode(t or "") for p in [b_side.id_to_piece(i)]]
        if not t or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append((0, 0, [], []))
            continue
        groups, links, at = [], [], [0, 0]
        ga, gb, a_rest, b_rest = [], [], list(a), list(b)
        while a_rest or b_rest:
            side = 0 if at[0] <= at[1] else 1
            i, x = (a_rest, b_rest)[side].pop(0)
            (ga, gb)[side].append(i)
            at[side] += len(x)
            if at[0] == at[1]:
                groups.append((ga, gb))
                links.append((ga[-1], gb[-1]))
                ga, gb = [], []
        rows.append((len(a), len(b), groups, links))
        count.update(links)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    for n_a, n_b, groups, links in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else "")


def _byte_characters() -> list[str]:
    spare = iter(range(256, 512))
    return [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(spare)) for b in range(256)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def supported(df):
    return token_alignment.with_support(token_alignment.written(token_alignment.align_texts(df, *FILES), "test"), *FILES)


def test_alignment_of_odd_texts(spark):
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumns({c: F.lit("x") for c in NAMES}).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in supported(df).collect()}
    assert got == {i if i != 3 else None: x for i, x in enumerate(plain_alignment(TEXTS))}
    assert supported(df.where("false")).count() == 0
    twice = supported(df.unionAll(df)).collect()
    assert Counter((r.doc_id, r.n_links, r.groups_sha256) for r in twice) == Counter({(i, x[3], x[6]): 2 for i, x in got.items()})


def test_alignment_of_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in registry.queries()["op12_token_alignment"](spark, sf_dir).collect()}
    assert got == {(r.doc_id, *x) for r, x in zip(docs, plain_alignment([r.text for r in docs]))}


def test_chunks_join_to_whole_texts(monkeypatch):
    """Chunks at single spaces give the ids of the whole text, however few are remembered."""
    rnd = random.Random(4)
    words = ["it's", "Wörter", "of", "12", "北京", "'re", "a-b", "  two", "\n", "end.", "x" * 30, "\u00a0", "\x1c", "\x85", "١٢", "e\u0301", "<|endoftext|>", "\u2003y", "don 't"]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 60))) for _ in range(200)] + [None, ""]
    own = token_alignment.Aligner(*FILES)
    for most in (100_000, 3):
        monkeypatch.setattr(token_alignment, "MEMO", most)
        for text, ids in zip(texts, own.encode(texts)):
            assert (ids is None) == (not text)
            if text:
                assert ids[0].tolist() == own.side_a.encode(" " + text, add_special_tokens=False).ids and ids[1].tolist() == own.side_b.encode(text)


def test_groups_and_counts(spark):
    df = spark.createDataFrame([(1, "käse and straße"), (2, "käse and straße"), (3, None)], "doc_id long, text string")
    aligned = token_alignment.align_texts(df, *FILES, keep_groups=True).cache()
    own = token_alignment.Aligner(*FILES)
    for r in aligned.collect():
        sides = [[x.split(",") for x in g.split("|")] for g in r.groups.split(";") if g]
        ends, whole = [], b""
        for a, b in sides:
            assert b"".join(own.a_bytes[int(i)] for i in a) == b"".join(own.b_bytes[int(i)] for i in b)
            whole += b"".join(own.a_bytes[int(i)] for i in a)
            ends.append(len(whole))
        assert r.cuts == ends and (not sides or whole.decode() == " käse and straße") and len(ends) == r.n_groups
    counts = {(r.a_id, r.b_id): r.n for r in token_alignment.pair_counts(aligned, *FILES).collect()}
    first = aligned.where("doc_id = 1").first()
    assert sum(counts.values()) == 2 * first.n_groups and all(n % 2 == 0 for n in counts.values())
    for a, b in counts:
        assert own.a_bytes[a].endswith(own.b_bytes[b]) or own.b_bytes[b].endswith(own.a_bytes[a])


def test_packed_sets():
    rnd = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        places = np.flatnonzero(rnd.random(size) < 0.3)
        bits = token_alignment.bitset(places, size)
        assert token_alignment.members(bits).tolist() == places.tolist()
        at = np.arange(size)
        assert token_alignment.ranks(bits, at).tolist() == np.searchsorted(places, at, "right").tolist()


# archives

PAGES = [(1, "http://a/ b\r\nc", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://a", "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\nnot a head\r\n\r\n"), (6, "u", "ü🙂\x00" * 9), (7, "u", "y" * (17 << 20)), (None, "u", "<p>same</p>"), (None, "u", "alone")]


def plain_archive(pages):
    for key, _, text in pages:
        raw = (text or "").encode()
        largest = max((k for k, _, t in pages if (t or "") == (text or "") and k is not None), default=None)
        revisit = largest is not None and key != largest
        yield key, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None


def read_back(spark, path, **how):
    rows = warc.read_warc(spark, path, **how)
    return rows.withColumns({c: warc.record_key(f).cast("long") for c, f in (("page_id", "record_id"), ("refers_to", "refers_to"))})


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("told", [100_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, told):
    monkeypatch.setattr(warc, "TOLD", told)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in NAMES}).repartition(3)
    path = f"file://{tmp_path}/archive"
    warc.write_warc(pages, path)
    got = read_back(spark, path, keep_payload=True).collect()
    assert Counter(tuple(r[c] for c in FIELDS) for r in got) == Counter(plain_archive(PAGES))
    text = {k: (t or "").encode() for k, _, t in PAGES if k is not None}
    assert all(bytes(r.payload) == text[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    assert {r.url for r in got if r.page_id in (1, 2, 9)} == {"http://a/%20b%0D%0Ac", "about:blank", "http://a"}
    # whole files through Spark's reader give the same
    monkeypatch.setattr(warc, "STREAMED", set())
    assert sorted(map(repr, read_back(spark, path).drop("path").collect())) == sorted(repr(r) for r in read_back(spark, path).drop("path").collect())
    assert Counter(tuple(r[c] for c in FIELDS) for r in read_back(spark, path).collect()) == Counter(plain_archive(PAGES))


def test_archives_are_gzip_members_of_one_record(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/archive")
    (file,) = (tmp_path / "archive").glob("*.warc.gz")
    assert gzip.decompress(file.read_bytes()).count(b"WARC-Type: ") == 6
    rows = sorted(warc.read_warc(spark, f"file://{tmp_path}/archive").collect(), key=lambda r: r.offset)
    for r, end in zip(rows, [*(r.offset for r in rows[1:]), file.stat().st_size]):
        inflate = zlib.decompressobj(wbits=31)
        one = inflate.decompress(file.read_bytes()[r.offset : end])
        assert inflate.eof and not inflate.unused_data and one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n")


def test_damage_is_found(tmp_path, spark):
    good = warc.member(warc.record("1", "u", b"payload", None, "1970-01-01T00:00:00Z"))
    cases = {
        "cut": good[:-9], "digest": warc.member(gzip.decompress(good).replace(b"payload", b"PAYLOAD")),
        "length": warc.member(gzip.decompress(good).replace(b"payload", b"pay")), "other": gzip.compress(b"hello\r\n\r\n"),
    }
    for name, data in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(good + data)
        with pytest.raises(Exception, match="x.warc.gz"):
            warc.read_warc(spark, f"file://{tmp_path}/{name}").collect()
    assert [r.intact for r in warc.read_warc(spark, f"file://{tmp_path}/digest", strict=False).orderBy("offset").collect()] == [True, False]
    foreign = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.warc.gz").write_bytes(gzip.compress(foreign) + good)
    assert [(r.record_type, r.payload_bytes) for r in warc.read_warc(spark, f"file://{tmp_path}/foreign").orderBy("offset").collect()] == [("warcinfo", 4), ("response", 7)]


def test_empty_tables_and_hot_payloads(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("page"), "id")).alias("html"))
    warc.write_warc(rows.where("false"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_warc(rows.repartition(20), f"file://{tmp_path}/hot")
    got = read_back(spark, f"file://{tmp_path}/hot").groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 2001, "revisit": 999}
