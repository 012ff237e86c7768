"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from framewright.llm.filter_audit import OP13_SQL, op13_filter_audit
from framewright.llm.html_layout import op10_html_layout
from framewright.llm.langid import op2_language_id
from framewright.llm.matroska import op5_matroska
from framewright.llm.maxent import op12_maxent_scores
from framewright.llm.mixing import OP9_SQL, op9_mix_sources
from framewright.llm.ngram_join import OP6_SQL, op6_ngram_jaccard_join
from framewright.llm.packing import op3_best_fit_packing
from framewright.llm.phrases import OP11_SQL, op11_phrase_collocations
from framewright.llm.secrets import OP8_SQL, op8_secret_scan
from framewright.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from framewright.llm.topk import OP1_SQL, op1_exact_topk
from framewright.llm.warc import op4_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (op1_exact_topk, op2_language_id, op3_best_fit_packing, op4_warc_derivatives, op5_matroska, op6_ngram_jaccard_join, op7_substring_dedup, op8_secret_scan, op9_mix_sources, op10_html_layout, op11_phrase_collocations, op12_maxent_scores, op13_filter_audit)
}
ORACLES = {"op1_exact_topk": OP1_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_secret_scan": OP8_SQL, "op9_mix_sources": OP9_SQL, "op11_phrase_collocations": OP11_SQL, "op13_filter_audit": OP13_SQL}
