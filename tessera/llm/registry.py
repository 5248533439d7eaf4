"""The queries of this subpackage and their SQL: thin bindings of the operators to the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, dualtree, html_crf, langid, licences, negatives, quality, repair, simhash, token_counts, transducer, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_divergence(spark, sf_dir):
    return quality.report(_table(spark, sf_dir, "documents"))


def op2_licence_digests(spark, sf_dir):
    return licences.scan(_table(spark, sf_dir, "documents"))


def op3_html_crf(spark, sf_dir):
    return html_crf.extract(_table(spark, sf_dir, "pages"))


def op4_sentencepiece_fst(spark, sf_dir):
    return transducer.encode(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_repair_tokens(spark, sf_dir):
    return repair.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op6_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, "text", F.col("lang"), F.col("source"))


def language_id_pages(spark, sf_dir):
    """The same operator where all its evidence exists: markup language, address and host."""
    pages = _table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)\\b.*?</\\1>", " "), "(?s)<[^>]*>", " ")
    rows = pages.select(
        F.col("page_id").alias("doc_id"),
        body.alias("text"),
        F.nullif(F.regexp_extract("html", "(?i)<html[^>]*\\blang=[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
        F.try_parse_url("url", F.lit("HOST")).alias("host"),
    )
    return langid.identify(rows, "text", F.col("declared"), F.col("host")).withColumnRenamed("doc_id", "page_id")


def op7_token_counts(spark, sf_dir):
    return token_counts.count(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(own)))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_dual_tree_lloyd(spark, sf_dir):
    return dualtree.cluster(_table(spark, sf_dir, "embeddings"))


def op12_warc_chain(spark, sf_dir):
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


QUERIES = (
    (op1_quality_divergence, quality.SQL),
    (op2_licence_digests, licences.SQL),
    (op3_html_crf, None),
    (op4_sentencepiece_fst, None),
    (op5_repair_tokens, None),
    (op6_language_id, None),
    (op7_token_counts, None),
    (op8_simhash, None),
    (op9_chat_format, chat.SQL),
    (op10_decontaminate, decontaminate.SQL),
    (op11_dual_tree_lloyd, dualtree.SQL),
    (op12_warc_chain, warc.SQL),
    (op13_hard_negatives, negatives.SQL),
    (language_id_pages, None),
)


def queries():
    return {f.__name__: f for f, _ in QUERIES}


def oracle_sql():
    return {f.__name__: sql for f, sql in QUERIES if sql}
