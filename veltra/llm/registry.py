"""The operators' queries and, where SQL can express them, their SQL."""

from veltra.llm.chaining import op7_chaining
from veltra.llm.jaccard import OP1_SQL, op1_jaccard_join
from veltra.llm.media import op8_media
from veltra.llm.mixing import op10_mixing
from veltra.llm.quality import op5_quality
from veltra.llm.sentencepiece_bpe import op2_sentencepiece
from veltra.llm.suffix_dedup import op3_suffix_dedup
from veltra.llm.topk import OP6_SQL, op6_topk
from veltra.llm.toxicity import op4_toxicity
from veltra.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_topk": op6_topk,
    "op7_chaining": op7_chaining,
    "op8_media": op8_media,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
}

ORACLE: dict[str, str] = {
    "op1_jaccard_join": OP1_SQL,
    "op6_topk": OP6_SQL,
    "op9_warc": OP9_SQL,
}
