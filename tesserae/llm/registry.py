"""The registered queries of this package."""

from __future__ import annotations

from tesserae.llm.embeddings import op10_cover_tree
from tesserae.llm.line_dedup import OP6_SQL, op6_line_dedup
from tesserae.llm.media import op1_progressive_jpeg
from tesserae.llm.mixing import OP2_SQL, op2_mix_sources
from tesserae.llm.negatives import OP13_SQL, op13_hard_negatives
from tesserae.llm.packing import op8_packing
from tesserae.llm.phrases import op3_phrases
from tesserae.llm.simhash import op9_simhash
from tesserae.llm.spelling import op12_spelling
from tesserae.llm.suffixes import op7_suffixes
from tesserae.llm.toxicity import op4_toxicity
from tesserae.llm.warc import OP11_SQL, op11_warc_bundles
from tesserae.llm.wavelet import op5_wavelet


def queries() -> dict:
    return {
        "op1_progressive_jpeg": op1_progressive_jpeg,
        "op2_mix_sources": op2_mix_sources,
        "op3_phrases": op3_phrases,
        "op4_toxicity": op4_toxicity,
        "op5_wavelet": op5_wavelet,
        "op6_line_dedup": op6_line_dedup,
        "op7_suffixes": op7_suffixes,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_cover_tree": op10_cover_tree,
        "op11_warc_bundles": op11_warc_bundles,
        "op12_spelling": op12_spelling,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op6_line_dedup": OP6_SQL, "op11_warc_bundles": OP11_SQL, "op13_hard_negatives": OP13_SQL}
