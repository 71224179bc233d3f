"""Operators of a training-data pipeline.  Nothing else in the package imports this subpackage."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_text, langid, lines, secrets, sharding, simhash, token_output


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_orc_token_ids": token_output.op2_orc_token_ids,
        "op3_minhash_containment": decontaminate.op3_minhash_containment,
        "op4_sentencepiece_bpe": bpe.op4_sentencepiece_bpe,
        "op5_secret_ownership": secrets.op5_secret_ownership,
        "op6_hypergeometric_shards": sharding.op6_hypergeometric_shards,
        "op7_mph_line_dedup": lines.op7_mph_line_dedup,
        "op8_ftrl_language": langid.op8_ftrl_language,
        "op9_wrapper_induction": html_text.op9_wrapper_induction,
        "op10_simhash_bitsliced": simhash.op10_simhash_bitsliced,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE_SQL, "op3_minhash_containment": decontaminate.ORACLE_SQL, "op7_mph_line_dedup": lines.ORACLE_SQL}
