"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strataforge.llm.isomedia import op6_media_columns
from strataforge.llm.licenses import ORACLE as LICENSE_SQL
from strataforge.llm.licenses import op8_license_scans
from strataforge.llm.mixing import ORACLE as MIX_SQL
from strataforge.llm.mixing import op2_mix_sources
from strataforge.llm.packing import op4_best_fit_packing
from strataforge.llm.passages import op5_near_passages
from strataforge.llm.quality import op1_quality_rules
from strataforge.llm.secrets import op9_secret_scans
from strataforge.llm.simhash import op7_simhash_dedup
from strataforge.llm.suffixes import op3_suffix_dedup
from strataforge.llm.toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_mix_sources,
        op3_suffix_dedup,
        op4_best_fit_packing,
        op5_near_passages,
        op6_media_columns,
        op7_simhash_dedup,
        op8_license_scans,
        op9_secret_scans,
        op10_toxicity,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_mix_sources": MIX_SQL, "op8_license_scans": LICENSE_SQL}
