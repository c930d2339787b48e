"""The subpackage's queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import centroid_clustering, chat_formatting, url_filters
from corvid.llm.best_fit_packing import op10_best_fit_packing
from corvid.llm.centroid_clustering import op11_centroid_clustering
from corvid.llm.chat_formatting import op4_chat_formatting
from corvid.llm.conversation_repair import op12_conversation_repair
from corvid.llm.decontamination import op5_decontamination
from corvid.llm.html_extraction import op6_html_extraction
from corvid.llm.jaccard_join import op9_jaccard_join
from corvid.llm.language_id import language_id_pages, op8_language_id
from corvid.llm.minhash_dedup import op13_minhash_dedup
from corvid.llm.pii import op1_pii
from corvid.llm.quality_rules import op3_quality_rules
from corvid.llm.suffix_dedup import op7_suffix_dedup
from corvid.llm.url_filters import op2_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_url_filters, op3_quality_rules, op4_chat_formatting, op5_decontamination, op6_html_extraction, op7_suffix_dedup, op8_language_id, op9_jaccard_join, op10_best_fit_packing, op11_centroid_clustering, op12_conversation_repair, op13_minhash_dedup, language_id_pages)
}
ORACLE_SQL: dict[str, str] = {"op2_url_filters": url_filters.ORACLE_SQL, "op4_chat_formatting": chat_formatting.ORACLE_SQL, "op11_centroid_clustering": centroid_clustering.ORACLE_SQL}
