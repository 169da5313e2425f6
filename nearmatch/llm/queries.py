"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from nearmatch.llm import divergence, exact_dedup, licenses, manifest, mixing, packing, simhash, spotsigs, substring_dedup, suffix_dedup, toxicity, warc
from nearmatch.llm.html_extract import op7_html_extraction

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_fingerprints": spotsigs.op6_fingerprints,
    "op7_html_extraction": op7_html_extraction,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_license_scans": licenses.op10_license_scans,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": exact_dedup.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_warc": warc.SQL,
}
