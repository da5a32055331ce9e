"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from cadenza.llm.decontaminate import OP5_SQL, op5_decontamination
from cadenza.llm.gif_media import op3_gif_media
from cadenza.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from cadenza.llm.html_wrappers import op4_html_extraction
from cadenza.llm.language_id import op7_language_id
from cadenza.llm.minhash_dedup import OP8_SQL, op8_minhash_dedup
from cadenza.llm.pii import OP11_SQL, op11_pii
from cadenza.llm.quality import op10_quality_classifier
from cadenza.llm.ranked_search import OP13_SQL, op13_ranked_search
from cadenza.llm.sentencepiece_codec import op6_sentencepiece
from cadenza.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from cadenza.llm.suffix_dedup import OP2_SQL, op2_suffix_dedup
from cadenza.llm.warc_revisits import OP9_SQL, op9_warc_revisits


def queries() -> dict:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_gif_media": op3_gif_media,
        "op4_html_extraction": op4_html_extraction,
        "op5_decontamination": op5_decontamination,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_language_id": op7_language_id,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_warc_revisits": op9_warc_revisits,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_pii": op11_pii,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": OP1_SQL,
        "op2_suffix_dedup": OP2_SQL,
        "op5_decontamination": OP5_SQL,
        "op8_minhash_dedup": OP8_SQL,
        "op9_warc_revisits": OP9_SQL,
        "op11_pii": OP11_SQL,
        "op12_hard_negatives": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
