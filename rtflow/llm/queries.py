"""The queries of this subpackage, by name, and their equivalents in DuckDB SQL where there are any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rtflow.llm import merkle
from rtflow.llm.alignment import op13_tokenizer_alignment
from rtflow.llm.decontamination import op4_decontamination
from rtflow.llm.fingerprints import op5_fingerprints
from rtflow.llm.line_dedup import op1_line_dedup
from rtflow.llm.licenses import op2_license_scans
from rtflow.llm.mixing import op8_mixing
from rtflow.llm.near_join import op9_near_join
from rtflow.llm.pii import op10_pii
from rtflow.llm.secrets import op6_secret_scans
from rtflow.llm.sharding import op7_sharding
from rtflow.llm.toxicity import op3_toxicity
from rtflow.llm.vector_search import op11_vector_search

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scans": op2_license_scans,
        "op3_toxicity": op3_toxicity,
        "op4_decontamination": op4_decontamination,
        "op5_fingerprints": op5_fingerprints,
        "op6_secret_scans": op6_secret_scans,
        "op7_sharding": op7_sharding,
        "op8_mixing": op8_mixing,
        "op9_near_join": op9_near_join,
        "op10_pii": op10_pii,
        "op11_vector_search": op11_vector_search,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_tokenizer_alignment": op13_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": merkle.ORACLE_SQL}
