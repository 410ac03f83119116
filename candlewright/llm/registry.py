"""Queries of this subpackage and the SQL that some of them are checked against."""

from .bpe import op8_bpe
from .chat_format import op2_chat_format
from .decontamination import op1_benchmark_decontamination
from .html_extraction import op9_html_extraction
from .language_id import op5_language_id
from .lm_scoring import op7_lm_scoring
from .ngram_join import op4_ngram_jaccard_join
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP3_SQL, op3_quality_rules
from .ranked_search import OP12_SQL, op12_ranked_search
from .secret_scan import op6_secret_scan
from .topk_search import OP13_SQL, op13_topk_search

QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_language_id": op5_language_id,
    "op6_secret_scan": op6_secret_scan,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe": op8_bpe,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_topk_search": op13_topk_search,
}

SQL = {"op3_quality_rules": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_topk_search": OP13_SQL}
