"""Queries of this subpackage and, where SQL can express them, their SQL."""

from quillcast.llm.decontaminate import OP10_SQL, op10_decontaminate
from quillcast.llm.html_text import op3_html_text
from quillcast.llm.language import op4_identify_language
from quillcast.llm.language_model import op12_score_documents
from quillcast.llm.mixing import OP1_SQL, op1_mix_sources
from quillcast.llm.near_dedup import OP9_SQL, op9_near_dedup
from quillcast.llm.pii import op6_find_personal_data
from quillcast.llm.quality import ABLATION_SQL, OP5_SQL, op5_quality_rules, quality_ablation
from quillcast.llm.ranked_search import OP13_SQL, op13_ranked_search
from quillcast.llm.secrets import OP2_SQL, op2_secret_scan
from quillcast.llm.sharding import op8_shard
from quillcast.llm.token_alignment import op11_align_tokens
from quillcast.llm.token_files import op7_token_files

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_secret_scan": op2_secret_scan,
    "op3_html_text": op3_html_text,
    "op4_identify_language": op4_identify_language,
    "op5_quality_rules": op5_quality_rules,
    "quality_ablation": quality_ablation,
    "op6_find_personal_data": op6_find_personal_data,
    "op7_token_files": op7_token_files,
    "op8_shard": op8_shard,
    "op9_near_dedup": op9_near_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_align_tokens": op11_align_tokens,
    "op12_score_documents": op12_score_documents,
    "op13_ranked_search": op13_ranked_search,
}
ORACLE = {
    "op1_mix_sources": OP1_SQL,
    "op2_secret_scan": OP2_SQL,
    "op5_quality_rules": OP5_SQL,
    "quality_ablation": ABLATION_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op13_ranked_search": OP13_SQL,
}
