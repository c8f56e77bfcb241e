"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from guardspark.llm.bpe import op3_bpe
from guardspark.llm.conversation_repair import op13_conversation_repair
from guardspark.llm.decontaminate import op6_decontaminate
from guardspark.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from guardspark.llm.hilbert_shards import op4_hilbert_shards
from guardspark.llm.line_dedup import OP8_SQL, op8_line_dedup
from guardspark.llm.quality_rules import ABLATION_SQL, OP7_SQL, op7_quality_rules, quality_ablation
from guardspark.llm.simhash import op9_simhash
from guardspark.llm.source_divergence import OP12_SQL, op12_source_divergence
from guardspark.llm.suffix_dedup import op1_suffix_dedup
from guardspark.llm.token_files import op2_token_files
from guardspark.llm.toxicity import op10_toxicity
from guardspark.llm.weak_quality import op5_weak_quality


def queries() -> dict:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_token_files": op2_token_files,
        "op3_bpe": op3_bpe,
        "op4_hilbert_shards": op4_hilbert_shards,
        "op5_weak_quality": op5_weak_quality,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality_rules": op7_quality_rules,
        "op8_line_dedup": op8_line_dedup,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_source_divergence": op12_source_divergence,
        "op13_conversation_repair": op13_conversation_repair,
        "quality_ablation": quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": OP7_SQL, "quality_ablation": ABLATION_SQL, "op8_line_dedup": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op12_source_divergence": OP12_SQL}
