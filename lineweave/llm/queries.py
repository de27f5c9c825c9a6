"""Registered queries of this subpackage and their SQL."""
from .centroids import OP12_SQL, op12_centroids
from .chaining import op6_repeated_passages
from .decontam import op7_decontamination
from .filteraudit import OP13_SQL, op13_filter_audit
from .htmltext import OP11_SQL, op11_main_text
from .lmscore import op9_lm_scores
from .minhash import op5_near_duplicates
from .mixing import op3_mixing
from .suffixdedup import op2_suffix_dedup
from .tokencounts import op8_token_counts
from .urlfilter import OP4_SQL, op4_url_filters

from .pii import op10_pii
from .quality import OP1_SQL, op1_quality_rules

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_dedup, op3_mixing, op4_url_filters, op5_near_duplicates, op6_repeated_passages, op7_decontamination, op8_token_counts,
                                    op9_lm_scores, op10_pii, op11_main_text, op12_centroids, op13_filter_audit)}
ORACLES = {"op1_quality_rules": OP1_SQL, "op4_url_filters": OP4_SQL, "op11_main_text": OP11_SQL, "op12_centroids": OP12_SQL, "op13_filter_audit": OP13_SQL}
