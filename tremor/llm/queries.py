"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from tremor.llm.ball_kmeans import OP12_SQL, op12_ball_kmeans
from tremor.llm.byte_bpe import op13_byte_bpe
from tremor.llm.decontaminate import OP1_SQL, op1_decontaminate
from tremor.llm.language_crf import op3_language_id
from tremor.llm.lexical_search import OP11_SQL, op11_lexical_search
from tremor.llm.license_scan import op8_license_scan
from tremor.llm.lm_score import op7_lm_score
from tremor.llm.near_dedup import OP2_SQL, op2_near_dedup
from tremor.llm.html_text import op5_html_text
from tremor.llm.packing import op6_packing
from tremor.llm.pii import op4_pii
from tremor.llm.quality_fm import op10_quality_classifier
from tremor.llm.quality_rules import op9_quality_rules

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dedup": op2_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_html_text": op5_html_text,
    "op6_packing": op6_packing,
    "op7_lm_score": op7_lm_score,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op2_near_dedup": OP2_SQL, "op11_lexical_search": OP11_SQL, "op12_ball_kmeans": OP12_SQL}
