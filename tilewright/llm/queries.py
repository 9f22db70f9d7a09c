"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .additive_classifier import op2_additive_classifier
from .collocations import ORACLE_SQL as COLLOCATIONS_SQL
from .collocations import op13_collocations
from .decontaminate import op10_decontaminate
from .histogram_topk import ORACLE_SQL as TOPK_SQL
from .histogram_topk import op12_histogram_topk
from .jaccard_join import op5_jaccard_join
from .maxent_lm import op7_maxent_lm
from .perplexity_rules import op8_perplexity_rules
from .sort_means import ORACLE_SQL as SORT_MEANS_SQL
from .sort_means import op11_sort_means
from .token_counts import op4_token_counts
from .token_files import op3_token_files
from .trie_codec import op9_bpe_codec
from .url_filter import ORACLE_SQL as URL_FILTER_SQL
from .url_filter import op6_url_filter
from .warc_captures import ORACLE_SQL as WARC_SQL
from .warc_captures import op1_warc_captures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_captures": op1_warc_captures,
    "op2_additive_classifier": op2_additive_classifier,
    "op3_token_files": op3_token_files,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_url_filter": op6_url_filter,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_perplexity_rules": op8_perplexity_rules,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_decontaminate": op10_decontaminate,
    "op11_sort_means": op11_sort_means,
    "op12_histogram_topk": op12_histogram_topk,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_captures": WARC_SQL,
    "op6_url_filter": URL_FILTER_SQL,
    "op11_sort_means": SORT_MEANS_SQL,
    "op12_histogram_topk": TOPK_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
}
