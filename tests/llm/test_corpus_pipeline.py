"""The pipeline's stages, each against a plain version on the same input."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import brute_components
from ticklake.llm.decontamination import exact_shingles


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns
            now = rows(out)
            assert now.keys() <= before.keys()
        if name == "line_dedup":
            assert now.keys() == before.keys() and sum(map(len, filter(None, now.values()))) < sum(map(len, filter(None, before.values())))
        elif name == "near_dup":
            assert now.keys() == {i for i, *_, kept in brute_components(before.items()) if kept}
        elif name == "decontamination":
            items = [exact_shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            dirty = {i for i, t in before.items() if any(a and len(a & exact_shingles(t)) >= 0.8 * len(a) - 1e-9 for a in items)}
            assert now.keys() == before.keys() - dirty
        elif name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            clean = [i for i in before if labels.get(i) == 0]
            assert 0.8 * len(before) < len(now) <= len(before) and len(set(clean) & now.keys()) > 0.95 * len(clean)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            for r in out.collect():
                ids = sp.encode(before[r.doc_id] or "", add_bos=True, add_eos=True)
                assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
            assert out.count() == len(before)
        docs, before = out, now
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count()


def test_near_dup_stage_links_from_80_percent(spark, sf_dir):
    import random

    rnd = random.Random(6)
    texts = []
    for changed in (0, 2, 4, 5, 6):  # of 204 words, 200 shingles: similarities of about 0.95 to 0.74
        words = [f"w{rnd.randrange(10**9)}" for _ in range(204)]
        other = [f"x{k}" if k % 30 == 10 and k // 30 < changed else w for k, w in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {i for i, *_, k in brute_components(enumerate(texts), 80) if k}
    assert kept != {i for i, *_, k in brute_components(enumerate(texts), 85) if k} and len(kept) < len(texts)
    assert rows(dict(corpus_pipeline.STAGES)["near_dup"](spark, docs, sf_dir)).keys() == kept


def test_stages_on_awkward_rows(spark, sf_dir):
    text = "a line of words that is long enough\nanother line of words that is long enough too"
    rows = [(1, None), (2, ""), (None, "words without an id"), (None, None), (3, text), (3, text), (4, "word " * 30_000), (5, "short")]
    rows = [(i and 10**9 + i, t) for i, t in rows]  # no label has these
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("id", "row", "score", "predicted", "line", "key", "set", "lang", "source")}).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir)
        if name != "encoding":
            assert out.columns == docs.columns and out.where("id <> 'id' or score <> 'score'").count() == 0
        ids = sorted((r.doc_id or 10**9) - 10**9 for r in out.collect())
        assert ids == [0, 0, 1, 2, 3, 3, 4, 5], name
