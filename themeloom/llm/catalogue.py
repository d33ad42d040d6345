"""The queries of this subpackage, and those that SQL can state."""

from themeloom.llm.bpe import op5_bpe_encode_decode
from themeloom.llm.classlm import op3_class_lm
from themeloom.llm.exactdedup import OP13_SQL, op13_exact_dedup
from themeloom.llm.filteraudit import OP12_SQL, op12_filter_audit
from themeloom.llm.htmltext import op6_html_extraction
from themeloom.llm.linededup import OP4_SQL, op4_line_dedup
from themeloom.llm.neighbours import op2_inverted_multi_index
from themeloom.llm.packing import op7_best_fit_packing
from themeloom.llm.quality import op8_quality_mil
from themeloom.llm.resampling import op11_importance_resampling
from themeloom.llm.simhash import op9_simhash
from themeloom.llm.tokencount import op1_token_counts
from themeloom.llm.winnowing import op10_winnowing

QUERIES = (
    op1_token_counts,
    op2_inverted_multi_index,
    op3_class_lm,
    op4_line_dedup,
    op5_bpe_encode_decode,
    op6_html_extraction,
    op7_best_fit_packing,
    op8_quality_mil,
    op9_simhash,
    op10_winnowing,
    op11_importance_resampling,
    op12_filter_audit,
    op13_exact_dedup,
)

ORACLE = {
    "op4_line_dedup": OP4_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
