"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from nimboscale.llm.fingerprints import op6_document_fingerprints
from nimboscale.llm.lines import OP5_SQL, op5_line_dedup
from nimboscale.llm.mixing import op2_source_mix
from nimboscale.llm.pieces import op10_piece_samples
from nimboscale.llm.quality import op9_quality_rules
from nimboscale.llm.simhash import op3_simhash_near_dedup
from nimboscale.llm.spelling import OP12_SQL, op12_spelling_variants
from nimboscale.llm.suffixes import OP13_SQL, op13_suffix_dedup
from nimboscale.llm.telephony import op4_telephony_media
from nimboscale.llm.toxicity import op8_toxic_spans
from nimboscale.llm.url_rules import OP7_SQL, op7_url_filters
from nimboscale.llm.warc import OP1_SQL, op1_warc_archive
from nimboscale.llm.whitening import op11_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_archive, op2_source_mix, op3_simhash_near_dedup, op4_telephony_media, op5_line_dedup, op6_document_fingerprints, op7_url_filters, op8_toxic_spans, op9_quality_rules, op10_piece_samples,
        op11_embedding_whitening, op12_spelling_variants, op13_suffix_dedup,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op1_warc_archive": OP1_SQL, "op5_line_dedup": OP5_SQL, "op7_url_filters": OP7_SQL, "op12_spelling_variants": OP12_SQL, "op13_suffix_dedup": OP13_SQL}
