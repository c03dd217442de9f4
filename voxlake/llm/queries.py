"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import audit, collocations, decontaminate, embeddings, licenses, mixing, ngram_join, packing, pages, pii, sharding, tokens, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        decontaminate.op1_decontaminate,
        licenses.op2_licenses,
        tokens.op3_tokens,
        sharding.op4_sharding,
        toxicity.op5_toxicity,
        ngram_join.op6_ngram_join,
        embeddings.op7_near_dedup,
        pii.op8_pii,
        mixing.op9_mixing,
        pages.op10_pages,
        packing.op11_packing,
        collocations.op12_collocations,
        audit.op13_filter_audit,
    )
}

ORACLE = {
    "op1_decontaminate": decontaminate.SQL,
    "op4_sharding": sharding.SQL,
    "op6_ngram_join": ngram_join.SQL,
    "op7_near_dedup": embeddings.SQL,
    "op9_mixing": mixing.SQL,
    "op12_collocations": collocations.SQL,
    "op13_filter_audit": audit.SQL,
}
