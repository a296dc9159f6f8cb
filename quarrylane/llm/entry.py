"""The queries of this subpackage by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from . import licenses, linededup, mixing, ngrams, pieces, quality, simhash, topk, toxicity, urlfilter


def queries() -> dict:
    return {
        "op1_topk": topk.op1_topk,
        "op2_simhash": simhash.op2_simhash,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_sentencepiece": pieces.op4_sentencepiece,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_line_dedup": linededup.op6_line_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_url_filters": urlfilter.op8_url_filters,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_lm_scoring": ngrams.op10_lm_scoring,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": topk.OP1_SQL, "op3_license_scan": licenses.OP3_SQL, "op6_line_dedup": linededup.OP6_SQL, "op7_mixing": mixing.OP7_SQL, "op8_url_filters": urlfilter.OP8_SQL}
