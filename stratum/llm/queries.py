"""The corpus queries and their SQL."""

from stratum.llm.ann import op5_ann
from stratum.llm.exact_dedup import OP10_SQL, op10_exact_dedup
from stratum.llm.langid import op6_langid
from stratum.llm.lm import OP3_SQL, op3_lm_score
from stratum.llm.minhash import op1_minhash
from stratum.llm.mixing import OP9_SQL, op9_mixing
from stratum.llm.packing import op7_packing
from stratum.llm.quality import op8_quality
from stratum.llm.repeats import op4_repeats
from stratum.llm.sharding import op2_sharding

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_sharding": op2_sharding,
    "op3_lm_score": op3_lm_score,
    "op4_repeats": op4_repeats,
    "op5_ann": op5_ann,
    "op6_langid": op6_langid,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL = {
    "op3_lm_score": OP3_SQL,
    "op9_mixing": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
}
