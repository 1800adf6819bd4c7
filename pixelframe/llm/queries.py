"""The operators' queries, and their SQL where SQL can express them."""

from pixelframe.llm import op2_topk as op2
from pixelframe.llm import op3_decontaminate as op3
from pixelframe.llm import op5_backoff as op5
from pixelframe.llm import op8_tool_calls as op8
from pixelframe.llm import op10_licenses as op10
from pixelframe.llm import op11_resampling as op11
from pixelframe.llm import op13_fill_middle as op13
from pixelframe.llm.op1_sentencepiece import op1_sentencepiece
from pixelframe.llm.op4_quality import op4_quality
from pixelframe.llm.op6_suffixes import op6_suffixes
from pixelframe.llm.op7_warc import op7_warc
from pixelframe.llm.op9_simhash import op9_simhash
from pixelframe.llm.op12_language import op12_language

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_topk": op2.op2_topk,
    "op3_decontaminate": op3.op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_backoff": op5.op5_backoff,
    "op6_suffixes": op6_suffixes,
    "op7_warc": op7_warc,
    "op8_tool_calls": op8.op8_tool_calls,
    "op9_simhash": op9_simhash,
    "op10_licenses": op10.op10_licenses,
    "op11_resampling": op11.op11_resampling,
    "op12_language": op12_language,
    "op13_fill_middle": op13.op13_fill_middle,
}
ORACLE = {
    "op2_topk": op2.ORACLE, "op3_decontaminate": op3.ORACLE, "op5_backoff": op5.ORACLE, "op8_tool_calls": op8.ORACLE, "op10_licenses": op10.ORACLE,
    "op11_resampling": op11.ORACLE, "op13_fill_middle": op13.ORACLE,
}
