"""Queries of the training-data operators and their oracles."""

from __future__ import annotations

import corpus_pipeline
from docloom.llm import chat, decontamination, divergence, imatch, licenses, mixing, pii, quality, secrets, sharding, simhash, spelling, topk

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_simhash": simhash.op2_simhash,
    "op3_licenses": licenses.op3_licenses,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op5_imatch": imatch.op5_imatch,
    "op6_pii": pii.op6_pii,
    "op7_shard": sharding.op7_shard,
    "pipeline": corpus_pipeline.run,
    "op8_chat": chat.op8_chat,
    "op10_secrets": secrets.op10_secrets,
    "op9_quality": quality.op9_quality,
    "op11_spelling": spelling.op11_spelling,
    "op12_topk": topk.op12_topk,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES = {
    "op1_mix": mixing.OP1_SQL,
    "op3_licenses": licenses.OP3_SQL,
    "op4_decontaminate": decontamination.OP4_SQL,
    "op5_imatch": imatch.OP5_SQL,
    "op6_pii": pii.OP6_SQL,
    "op7_shard": sharding.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_secrets": secrets.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_topk": topk.OP12_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
