"""Queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate as op6
from . import hard_negatives as op13
from . import language_id as op3
from . import line_dedup as op11
from . import near_dedup as op7
from . import periodic_runs as op12
from . import quality_rules as op5
from . import secrets_scan as op8
from . import source_mix as op9
from . import substring_dedup as op2
from . import token_counts as op10
from . import toxicity as op4
from . import url_filter as op1


def queries():
    return {
        "op1_url_filter": op1.op1_url_filter,
        "op2_substring_dedup": op2.op2_substring_dedup,
        "op3_language_id": op3.op3_language_id,
        "op4_toxicity": op4.op4_toxicity,
        "op5_quality_rules": op5.op5_quality_rules,
        "op6_decontaminate": op6.op6_decontaminate,
        "op7_near_dedup": op7.op7_near_dedup,
        "op8_secrets_scan": op8.op8_secrets_scan,
        "op9_source_mix": op9.op9_source_mix,
        "op10_token_counts": op10.op10_token_counts,
        "op11_line_dedup": op11.op11_line_dedup,
        "op12_periodic_runs": op12.op12_periodic_runs,
        "op13_hard_negatives": op13.op13_hard_negatives,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_substring_dedup": op2.OP2_SQL,
        "op6_decontaminate": op6.OP6_SQL,
        "op7_near_dedup": op7.OP7_SQL,
        "op9_source_mix": op9.OP9_SQL,
        "op11_line_dedup": op11.OP11_SQL,
        "op13_hard_negatives": op13.OP13_SQL,
    }
