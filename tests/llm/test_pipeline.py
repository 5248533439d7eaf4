"""The pipeline's stages against brute-force versions of their decisions."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA
from tests.llm.test_ops import WORDS, brute_hits, lower
from tests.llm.test_similar import brute
from tessera.llm import langid, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "benchmark_decontamination", "sentencepiece"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, DATA).cache()
    ok = {r.doc_id for r in langid.identify(docs, "text", F.col("lang"), F.col("source")).where("kept").collect()}
    assert {r.doc_id for r in one.collect()} == ok and one.columns == docs.columns
    two = stage["quality_rules"](spark, one, DATA).cache()
    ok = {r.doc_id for r in quality.report(one).where("kept").collect()}
    assert {r.doc_id for r in two.collect()} == ok and two.columns == docs.columns
    three = stage["near_dedup"](spark, two, DATA).cache()
    assert {r.doc_id for r in three.collect()} == {least for _, least in brute([(r.doc_id, r.text) for r in two.collect()])}
    four = stage["benchmark_decontamination"](spark, three, DATA).cache()
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {x[0]: x for x in brute_hits([(r.doc_id, r.text) for r in three.collect()], bench)}
    left = {r.doc_id: r.text for r in four.collect()}
    assert any(x[2] for x in hits.values())
    before = {r.doc_id: r.text for r in three.collect()}
    for i, (_, n, hit, *_rest) in hits.items():
        if hit > 0.5 * n:
            assert i not in left
        elif hit:
            assert len(WORDS.findall(lower(left[i]))) == n - hit
        else:
            assert left[i] == before[i]
    assert not any(x[2] for x in brute_hits(left.items(), bench))
    five = stage["sentencepiece"](spark, four, DATA)
    assert five.count() == len(left) and not five.where("not round_trip").count()


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_chars", "n_tokens", "ids", "round_trip"] and out.count() > 100


def test_a_small_cache_changes_no_ids_and_is_kept_to(spark):
    import public_tokenizers

    from tessera.llm import transducer

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    some = sorted(map(tuple, transducer.encode(docs, model).collect()), key=repr)
    assert sorted(map(tuple, transducer.encode(docs, model, cache_bytes=20_000).collect()), key=repr) == some
    t = transducer.Transducer(transducer.Pieces(open(model, "rb").read()))
    t.room = 20_000
    for r in docs.limit(50).collect():
        t.encode(r.text or "")
    assert 0 < t.held <= 20_000
