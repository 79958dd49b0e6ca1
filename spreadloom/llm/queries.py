"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from spreadloom.llm import bpe, neardup, neighbours, packing, quality, secrets, sharding, tokenstore, toxicity, warc

QUERIES = {
    "op8_minhash_near_dedup": neardup.op8_minhash_near_dedup,
    "op9_nearest_neighbours": neighbours.op9_nearest_neighbours,
    "op4_toxicity": toxicity.op4_toxicity,
    "op1_warc": warc.op1_warc,
    "op7_token_binary": tokenstore.op7_token_binary,
    "op6_sharding": sharding.op6_sharding,
    "op2_bpe_encode_decode": bpe.op2_bpe_encode_decode,
    "op10_packing": packing.op10_packing,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op5_quality_rules": quality.op5_quality_rules,
}

SQL = {
    "op8_minhash_near_dedup": neardup.OP8_SQL,
    "op9_nearest_neighbours": neighbours.OP9_SQL,
    "op1_warc": warc.OP1_SQL,
    "op3_secret_scans": secrets.OP3_SQL,
    "op5_quality_rules": quality.OP5_SQL,
}
