"""The registered queries of this package and the SQL that they are checked against."""

from __future__ import annotations

import corpus_pipeline

from .bpe import op4_bpe_encoding
from .decontamination import op10_decontamination
from .language_id import op3_language_id
from .license_scan import op8_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .ngram_join import op5_ngram_jaccard
from .quality_rules import op6_quality_rules
from .quotations import op1_quotation_linking
from .resampling import op9_importance_resampling
from .toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_quotation_linking": op1_quotation_linking,
        "op2_line_dedup": op2_line_dedup,
        "op3_language_id": op3_language_id,
        "op4_bpe_encoding": op4_bpe_encoding,
        "op5_ngram_jaccard": op5_ngram_jaccard,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity": op7_toxicity,
        "op8_license_scan": op8_license_scan,
        "op9_importance_resampling": op9_importance_resampling,
        "op10_decontamination": op10_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL}
