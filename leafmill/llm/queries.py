"""The queries of this subpackage, by name, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, licenses, line_dedup, merkle, packing, ranked_search, simhash, token_files, toxicity, warc, winnowing

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_packing": packing.op4_packing,
    "op5_warc": warc.op5_warc,
    "op6_licenses": licenses.op6_licenses,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_simhash": simhash.op8_simhash,
    "op9_winnowing": winnowing.op9_winnowing,
    "op10_token_files": token_files.op10_token_files,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_merkle": merkle.op12_merkle,
    "op13_jaccard_join": jaccard_join.op13_jaccard_join,
}

ORACLES = {
    "op2_decontamination": decontamination.ORACLE,
    "op5_warc": warc.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_jaccard_join": jaccard_join.ORACLE,
}
