"""Registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

from candlewick.llm import bpe, gif, html_text, mixing, ordinal, phrases, quality_rules, secrets, sentence_pieces, simhash, suffixes, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_bpe": bpe.op2_bpe,
        "op3_gif_media": gif.op3_gif_media,
        "op4_html_text": html_text.op4_html_text,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_ordinal_quality": ordinal.op6_ordinal_quality,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_secret_scan": secrets.op10_secret_scan,
        "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
        "op12_phrases": phrases.op12_phrases,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict:
    return {
        "op5_url_filter": url_filter.oracle_sql(),
        "op7_quality_rules": quality_rules.ORACLE_SQL,
        "op9_suffix_dedup": suffixes.ORACLE_SQL,
        "op10_secret_scan": secrets.oracle_sql(),
        "op12_phrases": phrases.ORACLE_SQL,
        "op13_vector_codes": vector_codes.oracle_sql(),
    }
