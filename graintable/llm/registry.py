"""The subpackage's queries by name, and their equivalent SQL where there is one."""

from __future__ import annotations

from . import bpe, exact_dedup, importance, language, line_dedup, minhash, mixing, runs, sharding, substring_dedup, topk, url_filters, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_bpe": bpe.op5_bpe,
    "op6_language": language.op6_language,
    "op7_minhash": minhash.op7_minhash,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_topk": topk.op9_topk,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_importance": importance.op11_importance,
    "op12_runs": runs.op12_runs,
    "op13_warc": warc.op13_warc,
}
ORACLES = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op9_topk": topk.ORACLE_SQL,
    "op10_url_filters": url_filters.ORACLE_SQL,
    "op11_importance": importance.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
