"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import cascade as rules
from veriloom.llm import collocations as phrases
from veriloom.llm import turns, warc
from veriloom.llm.base import shared_dir, table
from veriloom.llm.chat import repair
from veriloom.llm.decontam import leaks
from veriloom.llm.html_main import main_text
from veriloom.llm.jaccard import jaccard_components
from veriloom.llm.packing import pack
from veriloom.llm.pii import personal_data
from veriloom.llm.quality_gam import quality
from veriloom.llm.simhash import near_duplicates
from veriloom.llm.toxicity import toxicity


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return main_text(table(spark, sf_dir, "pages"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))


def op3_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels with crc32(doc_id) mod 5 = 0 are held out."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 5, 0)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles at a Jaccard similarity of 0.9 or more, over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold=90)


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pairwise_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels with crc32(doc_id) mod 4 = 2 are held out."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 4, 2)


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over all documents, cheapest rejections first."""
    return rules.cascade(table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return repair(table(spark, sf_dir, "conversations"))


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))


def op10_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    folder = warc.new_folder(shared_dir(spark))
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_rank_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a fixed rule and repaired."""
    return turns.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_fingerprint_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of two to four words that each language ties closest, over all documents."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles at 4 or fewer differing bits, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, radius=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_template_removal": op1_template_removal,
        "op2_vector_packing": op2_vector_packing,
        "op3_toxic_segments": op3_toxic_segments,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_spaced_seeds": op5_spaced_seeds,
        "op6_pairwise_gam": op6_pairwise_gam,
        "op7_rule_cascade": op7_rule_cascade,
        "op8_role_repair": op8_role_repair,
        "op9_contextual_pii": op9_contextual_pii,
        "op10_warc_shards": op10_warc_shards,
        "op11_rank_convergence": op11_rank_convergence,
        "op12_fingerprint_phrases": op12_fingerprint_phrases,
        "op13_simhash_balls": op13_simhash_balls,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_rule_cascade": rules.ORACLE, "op10_warc_shards": warc.ORACLE, "op11_rank_convergence": turns.ORACLE, "op12_fingerprint_phrases": phrases.ORACLE}
