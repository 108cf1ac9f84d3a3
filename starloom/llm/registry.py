"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, byte_pairs, chat, decontaminate, language, licences, manifest, mixing, near_duplicates, passages, quality, token_index, vector_join


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_language": language.op1_language,
        "op2_chat": chat.op2_chat,
        "op3_licences": licences.op3_licences,
        "op4_token_index": token_index.op4_token_index,
        "op5_vector_join": vector_join.op5_vector_join,
        "op6_decontamination": decontaminate.op6_decontamination,
        "op7_mixing": mixing.op7_mixing,
        "op8_near_duplicates": near_duplicates.op8_near_duplicates,
        "op9_passages": passages.op9_passages,
        "op10_quality": quality.op10_quality,
        "op11_alignment": alignment.op11_alignment,
        "op12_byte_pairs": byte_pairs.op12_byte_pairs,
        "op13_manifest": manifest.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat": chat.OP2_SQL, "op5_vector_join": vector_join.OP5_SQL, "op6_decontamination": decontaminate.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op8_near_duplicates": near_duplicates.OP8_SQL, "op13_manifest": manifest.OP13_SQL}
