"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import embeddings, html, lines, mixing, ngram, packing, quality, rules, substrings, urls


def queries() -> dict:
    return {
        "op1_urls": urls.op1_urls,
        "op2_embeddings": embeddings.op2_embeddings,
        "op3_mixing": mixing.op3_mixing,
        "op4_packing": packing.op4_packing,
        "op5_html": html.op5_html,
        "op6_lines": lines.op6_lines,
        "op7_quality": quality.op7_quality,
        "op8_substrings": substrings.op8_substrings,
        "op9_rules": rules.op9_rules,
        "op10_ngram": ngram.op10_ngram,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_urls": urls.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op6_lines": lines.OP6_SQL,
        "op8_substrings": substrings.OP8_SQL,
        "op10_ngram": ngram.OP10_SQL,
    }
