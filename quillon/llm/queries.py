"""Queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from . import topk, urlfilter, warc
from .bpe import op10
from .decontam import op3
from .pii import op8
from .quality import op4
from .simhash import op9
from .substring import op7
from .toxicity import op6

QUERIES = {
    "op1_warc_revisits": warc.op1,
    "op2_url_filters": urlfilter.op2,
    "op3_decontamination": op3,
    "op4_quality": op4,
    "op5_topk_search": topk.op5,
    "op6_toxicity": op6,
    "op7_substring_dedup": op7,
    "op8_pii": op8,
    "op9_simhash_near_dedup": op9,
    "op10_bpe": op10,
}
ORACLES: dict[str, str] = {"op1_warc_revisits": warc.ORACLE, "op2_url_filters": urlfilter.ORACLE, "op5_topk_search": topk.ORACLE}
