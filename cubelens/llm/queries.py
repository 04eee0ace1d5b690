"""The operators' queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, decontaminate, exact_dedup, html_text, langid, license_scan, mixing, prefix_trie, simhash, substring, token_output, toxicity, vector_codes, warc


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return query(spark, sf_dir)

    return run


_ALL = (
    token_output.op1_token_output,
    toxicity.op2_toxicity,
    decontaminate.op3_decontamination,
    html_text.op4_html_text,
    mixing.op5_mixing,
    license_scan.op6_license_scan,
    exact_dedup.op7_exact_dedup,
    simhash.op8_simhash,
    substring.op9_substring,
    langid.op10_language_id,
    warc.op11_warc,
    vector_codes.op12_vector_codes,
    prefix_trie.op13_prefix_trie,
)
QUERIES = {f.__name__: _shipped(f) for f in _ALL}
ORACLES = {"op5_mixing": mixing.ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op11_warc": warc.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
