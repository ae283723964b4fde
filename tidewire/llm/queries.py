"""The training-data queries, one per operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Where the public tokenizer files are described; the path is a parameter of the packing operator.
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 40


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import held_out, score_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, docs.where(~held_out())).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality

    docs = table(spark, sf_dir, "documents")
    return fit_quality(docs, table(spark, sf_dir, "labels")).score(docs)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import search

    return search(table(spark, sf_dir, "embeddings"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_rows

    out = dedup_rows(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", "text", F.sha2("text", 256).alias("text_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(table(spark, sf_dir, "embeddings"))[0]


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_score, op2_quality, op3_html_extract, op4_simhash, op5_sharding, op6_mixing, op7_packing, op8_permutation_index, op9_exact_dedup, op10_line_dedup, op11_vector_codes, op12_decontamination, op13_prefix_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    from . import decontaminate, prefix_trie, vector_codes

    found = {
        "op11_vector_codes": vector_codes.sql(),
        "op12_decontamination": decontaminate.sql(),
        "op13_prefix_trie": prefix_trie.sql(),
        "op9_exact_dedup": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
            g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
            FROM d JOIN g ON d.norm = g.norm
        """,
    }
    return found | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
