"""Queries and SQL of the corpus operators, by contract name."""

from __future__ import annotations

import corpus_pipeline

from . import op1_sentencepiece as _1
from . import op2_warc_revisit as _2
from . import op3_line_dedup as _3
from . import op4_quality_rules as _4
from . import op5_quote_links as _5
from . import op6_pii_crf as _6
from . import op7_html_main as _7
from . import op8_ring_shards as _8
from . import op9_jaccard_join as _9
from . import op10_decontaminate as _10
from . import op11_importance as _11
from . import op12_substring_dedup as _12
from . import op13_periodic_runs as _13

QUERIES = {
    "op1_sentencepiece": _1.op1_sentencepiece,
    "op2_warc_revisit": _2.op2_warc_revisit,
    "op3_line_dedup": _3.op3_line_dedup,
    "op4_quality_rules": _4.op4_quality_rules,
    "quality_ablations": _4.quality_ablations,
    "op5_quote_links": _5.op5_quote_links,
    "op6_pii_crf": _6.op6_pii_crf,
    "op7_html_main": _7.op7_html_main,
    "op8_ring_shards": _8.op8_ring_shards,
    "op9_jaccard_join": _9.op9_jaccard_join,
    "op10_decontaminate": _10.op10_decontaminate,
    "op11_importance": _11.op11_importance,
    "op12_substring_dedup": _12.op12_substring_dedup,
    "op13_periodic_runs": _13.op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op2_warc_revisit": _2.ORACLE,
    "op3_line_dedup": _3.ORACLE,
    "op4_quality_rules": _4.ORACLE,
    "quality_ablations": _4.ABLATIONS,
    "op5_quote_links": _5.ORACLE,
    "op9_jaccard_join": _9.ORACLE,
    "op10_decontaminate": _10.ORACLE,
    "op11_importance": _11.ORACLE,
    "op12_substring_dedup": _12.ORACLE,
    "op13_periodic_runs": _13.ORACLE,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
