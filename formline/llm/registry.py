"""Queries of the llm subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from formline.llm import (
    op1_quality,
    op2_pieces,
    op3_tokens,
    op4_secrets,
    op5_jaccard,
    op6_classifier,
    op7_sharding,
    op8_transport,
    op9_mixing,
    op10_substrings,
    oracles,
    pipeline,
)


def queries() -> dict:
    found = [
        op1_quality.op1_quality,
        op2_pieces.op2_pieces,
        op3_tokens.op3_tokens,
        op4_secrets.op4_secrets,
        op5_jaccard.op5_jaccard,
        op6_classifier.op6_classifier,
        op7_sharding.op7_sharding,
        op8_transport.op8_transport,
        op9_mixing.op9_mixing,
        op10_substrings.op10_substrings,
    ]
    return {**{f.__name__: f for f in found}, "pipeline": pipeline.run}


def oracle_sql() -> dict:
    out = {"op5_jaccard": oracles.JACCARD, "op9_mixing": op9_mixing.ORACLE, "op10_substrings": oracles.SUBSTRINGS}
    return {**out, **({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})}
