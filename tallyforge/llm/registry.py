"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import codebooks, decontaminate, flac, html_text, langid, licenses, line_dedup, lm, ngram_join, periodic_runs, pieces_bpe, simhash, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_pieces": pieces_bpe.op3_pieces,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_language_id": langid.op6_language_id,
    "op7_licenses": licenses.op7_licenses,
    "op8_flac": flac.op8_flac,
    "op9_lm_score": lm.op9_lm_score,
    "op10_html_text": html_text.op10_html_text,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_vector_codes": codebooks.op12_vector_codes,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE_SQL = {
    "op1_warc": warc.OP1_SQL,
    "op4_ngram_join": ngram_join.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_licenses": licenses.OP7_SQL,
    "op11_periodic_runs": periodic_runs.OP11_SQL,
    "op12_vector_codes": codebooks.OP12_SQL,
}
