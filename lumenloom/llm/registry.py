"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.alignment import op11_cross_tokenizer
from lumenloom.llm.chat_format import OP1_SQL, op1_chat_format
from lumenloom.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from lumenloom.llm.language_id import op2_language_id
from lumenloom.llm.license_scan import op5_license_scan
from lumenloom.llm.merkle import OP13_SQL, op13_merkle_manifest
from lumenloom.llm.mixing import OP8_SQL, op8_mix_sources
from lumenloom.llm.near_dedup import op6_minhash_dedup
from lumenloom.llm.packing import op9_pack_sequences
from lumenloom.llm.quality import OP4_SQL, op4_quality_rules
from lumenloom.llm.token_counts import op10_token_counts
from lumenloom.llm.token_files import op12_token_files
from lumenloom.llm.warc import op7_warc

_QUERIES = [op1_chat_format, op2_language_id, op3_exact_dedup, op4_quality_rules, op5_license_scan, op6_minhash_dedup, op7_warc, op8_mix_sources, op9_pack_sequences, op10_token_counts, op11_cross_tokenizer, op12_token_files, op13_merkle_manifest]
_SQL = {"op1_chat_format": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op4_quality_rules": OP4_SQL, "op8_mix_sources": OP8_SQL, "op13_merkle_manifest": OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return _SQL
