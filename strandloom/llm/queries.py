"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from strandloom.llm import bpe_codec, decontaminate, language, licenses, merkle, packing, pii, quality, repeats, search, simhash, token_counts, token_files

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_language": language.op3_language,
    "op4_repeat_removal": repeats.op4_repeat_removal,
    "op5_simhash": simhash.op5_simhash,
    "op6_pii": pii.op6_pii,
    "op7_bpe_codec": bpe_codec.op7_bpe_codec,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_token_files": token_files.op10_token_files,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_packing": packing.op13_packing,
}

ORACLES = {"op1_license_scan": licenses.ORACLE_SQL, "op11_lexical_search": search.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL}
