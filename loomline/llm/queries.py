"""The queries of the thirteen operators and the SQL for those that SQL can express."""

from loomline.llm import decontaminate, fingerprint, html_extract, importance, language, linededup, mixing, pieces, secrets, simhash, spelling, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_secret_scan": secrets.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_source_mixing": mixing.query,
    "op6_language_id": language.query,
    "op7_line_dedup": linededup.query,
    "op8_html_extraction": html_extract.query,
    "op9_url_filter": urls.query,
    "op10_document_fingerprints": fingerprint.query,
    "op11_importance_resampling": importance.query,
    "op12_spelling_variants": spelling.query,
    "op13_sentencepiece": pieces.query,
}

SQL = {
    "op3_secret_scan": secrets.SQL,
    "op4_benchmark_decontamination": decontaminate.SQL,
    "op5_source_mixing": mixing.SQL,
    "op9_url_filter": urls.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_spelling_variants": spelling.SQL,
}
