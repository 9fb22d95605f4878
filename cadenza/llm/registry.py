"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import OP10_SQL, op10_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .html_extract import op3_html_extract
from .importance import OP13_SQL, op13_importance
from .knn_join import OP6_SQL, op6_exact_topk
from .license_scan import OP4_SQL, op4_license_scan
from .packing import op9_best_fit_packing
from .piece_codec import op12_sentencepiece
from .quality_lm import op7_quality_lm
from .simhash import op2_simhash
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op8_toxicity
from .url_filter import op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_simhash": op2_simhash,
    "op3_html_extract": op3_html_extract,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_topk": op6_exact_topk,
    "op7_quality_lm": op7_quality_lm,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_divergence": op11_divergence,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance": op13_importance,
}

ORACLES = {
    "op4_license_scan": OP4_SQL,
    "op6_exact_topk": OP6_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_divergence": OP11_SQL,
    "op13_importance": OP13_SQL,
}
