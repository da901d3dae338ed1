"""The registered queries of the training-data operators and the SQL that expresses them."""

from lodestone.llm.fingerprints import op7_fingerprints
from lodestone.llm.line_dedup import op4_line_dedup
from lodestone.llm.mixing import OP1_SQL, op1_mixing
from lodestone.llm.near_duplicates import op8_near_duplicates
from lodestone.llm.pieces import op10_sentencepiece
from lodestone.llm.ppm import op5_ppm
from lodestone.llm.quality import op2_quality
from lodestone.llm.rules import OP6_SQL, op6_rules
from lodestone.llm.toxicity import op9_toxicity
from lodestone.llm.wordpiece import op3_token_counts

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_ppm": op5_ppm,
    "op6_rules": op6_rules,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL = {"op1_mixing": OP1_SQL, "op6_rules": OP6_SQL}
