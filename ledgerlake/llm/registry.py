"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from ledgerlake.llm.bpe import op4_bpe_round_trip
from ledgerlake.llm.chat_format import OP9_SQL, op9_chat_windows
from ledgerlake.llm.decontamination import op6_decontamination
from ledgerlake.llm.html_extraction import op11_html_extraction
from ledgerlake.llm.importance_resampling import op12_importance_resampling
from ledgerlake.llm.language_id import op8_language_id
from ledgerlake.llm.quality_net import op1_quality_net
from ledgerlake.llm.quality_rules import op2_quality_rules
from ledgerlake.llm.simhash_dedup import op3_simhash_dedup
from ledgerlake.llm.spelling_variants import op13_spelling_variants
from ledgerlake.llm.suffix_dedup import op5_suffix_dedup
from ledgerlake.llm.token_counts import op7_token_counts
from ledgerlake.llm.warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_quality_net, op2_quality_rules, op3_simhash_dedup, op4_bpe_round_trip, op5_suffix_dedup, op6_decontamination, op7_token_counts, op8_language_id, op9_chat_windows, op10_warc, op11_html_extraction, op12_importance_resampling, op13_spelling_variants)}
ORACLE: dict[str, str] = {"op9_chat_windows": OP9_SQL, "op10_warc": OP10_SQL}
