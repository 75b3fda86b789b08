"""Registered queries of the corpus operators: name -> (function, SQL or None)."""

from __future__ import annotations

from . import chat, chunks, decontam, jaccard, langid, linecrf, merkle, packing, pii, quality, repair, topk, toxicity
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_format(spark, sf_dir):
    return chat.read_back(chat.expand(chat.with_control(table(spark, sf_dir, "conversations"))))


def op3_chunk_dedup(spark, sf_dir):
    return chunks.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_jaccard(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op4_link_counts(spark, sf_dir):
    return jaccard.link_counts(table(spark, sf_dir, "documents"))


def op5_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_language_id(spark, sf_dir):
    return langid.predict(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_decontaminate(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sanitise(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_line_quality(spark, sf_dir):
    return linecrf.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_repair(spark, sf_dir):
    return repair.report(repair.repair(repair.damage(table(spark, sf_dir, "conversations")), "dropped"))


REGISTRY = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_chat_format": (op2_chat_format, chat.ORACLE_SQL),
    "op3_chunk_dedup": (op3_chunk_dedup, None),
    "op4_ngram_jaccard": (op4_ngram_jaccard, jaccard.ORACLE_SQL),
    "op4_link_counts": (op4_link_counts, jaccard.LINKS_SQL),
    "op5_pack": (op5_pack, None),
    "op6_language_id": (op6_language_id, None),
    "op7_decontaminate": (op7_decontaminate, None),
    "op8_sanitise": (op8_sanitise, None),
    "op9_quality": (op9_quality, None),
    "op10_topk": (op10_topk, topk.ORACLE_SQL),
    "op11_merkle_manifest": (op11_merkle_manifest, merkle.ORACLE_SQL),
    "op12_line_quality": (op12_line_quality, None),
    "op13_repair": (op13_repair, repair.ORACLE_SQL),
}
