"""The queries of this subpackage, by name, and the SQL that states their result where SQL can."""

from __future__ import annotations

from tailwright.llm.bpe import op3_byte_bpe
from tailwright.llm.collocations import op11_collocations
from tailwright.llm.collocations import sql as collocations_sql
from tailwright.llm.decontaminate import op9_decontaminate
from tailwright.llm.langid import op2_language_id
from tailwright.llm.line_crf import op8_quality
from tailwright.llm.line_dedup import op13_line_dedup
from tailwright.llm.line_dedup import sql as line_dedup_sql
from tailwright.llm.near_dedup import op4_probminhash
from tailwright.llm.ppm import op1_ppm
from tailwright.llm.quality_rules import op5_fertility
from tailwright.llm.resampling import op12_importance
from tailwright.llm.resampling import sql as resampling_sql
from tailwright.llm.token_counts import op10_token_counts
from tailwright.llm.toxicity import op6_toxicity
from tailwright.llm.url_filter import op7_url_filter
from tailwright.llm.url_filter import sql as url_filter_sql

QUERIES = {
    "op1_ppm": op1_ppm,
    "op2_language_id": op2_language_id,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_probminhash": op4_probminhash,
    "op5_fertility": op5_fertility,
    "op6_toxicity": op6_toxicity,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_importance": op12_importance,
    "op13_line_dedup": op13_line_dedup,
}

#: The models and hashes of the others can't be stated in it.
ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": url_filter_sql(),
    "op11_collocations": collocations_sql(),
    "op12_importance": resampling_sql(),
    "op13_line_dedup": line_dedup_sql(),
}
