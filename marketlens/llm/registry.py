"""The queries of this subpackage and the SQL for those that SQL can express."""

from . import bpe, cotrain, html_extract, packing, quality_rules, secrets, simhash, topk, toxicity, url_filter

QUERIES = {
    "op1_cotraining": cotrain.query,
    "op2_html_extract": html_extract.query,
    "op3_url_filter": url_filter.query,
    "op4_bpe": bpe.query,
    "op5_topk": topk.query,
    "op6_quality_rules": quality_rules.query,
    "op7_simhash": simhash.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_secret_scan": secrets.query,
}
ORACLES = {
    "op3_url_filter": url_filter.ORACLE,
    "op5_topk": topk.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_secret_scan": secrets.ORACLE,
}
