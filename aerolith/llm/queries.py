"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, langid, merkle, mtree, pii, quality, quantise, secrets, simhash, token_files, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
    "op2_chat_format": chat.op2_chat_format,
    "op3_pii": pii.op3_pii,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_language_id": langid.op5_language_id,
    "op6_bpe_encode_decode": bpe.op6_bpe_encode_decode,
    "op7_exact_top_k": mtree.op7_exact_top_k,
    "op8_token_files": token_files.op8_token_files,
    "op9_quality": quality.op9_quality,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_vector_codes": quantise.op13_vector_codes,
}
ORACLES: dict[str, str] = {
    "op2_chat_format": chat.ORACLE_SQL,
    "op4_decontamination": decontaminate.ORACLE_SQL,
    "op7_exact_top_k": mtree.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_vector_codes": quantise.ORACLE_SQL,
}
