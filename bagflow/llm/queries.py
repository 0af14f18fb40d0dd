"""The queries of this package and their SQL."""

from __future__ import annotations

from bagflow.llm import bpe, decontaminate, dedup, html, lm, oracles, quality, sharding, suffix, urls, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_minhash": dedup.op2_minhash,
    "op3_suffix": suffix.op3_suffix,
    "op4_warc": warc.op4_warc,
    "op5_sharding": sharding.op5_sharding,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_bpe": bpe.op7_bpe,
    "op8_lm": lm.op8_lm,
    "op9_urls": urls.op9_urls,
    "op10_quality": quality.op10_quality,
}

#: DuckDB SQL; the other queries can't be said in SQL and are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {"op2_minhash": dedup.ORACLE, "op3_suffix": suffix.ORACLE, "op4_warc": warc.ORACLE, "op5_sharding": oracles.SHARDS, "op10_quality": oracles.QUALITY}
