"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from driftlens.llm import alignment, bpe, chat, gif, itq, jaccard, langid, lpf, merkle, mixing, packing, suffixtree, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_lpf": lpf.op2_lpf,
    "op3_suffixtree": suffixtree.op3_suffixtree,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_chat": chat.op5_chat,
    "op6_bpe": bpe.op6_bpe,
    "op7_gif": gif.op7_gif,
    "op8_itq": itq.op8_itq,
    "op9_language": langid.op9_language,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_merkle": merkle.op11_merkle,
    "op12_alignment": alignment.op12_alignment,
    "op13_packing": packing.op13_packing,
}
SQL: dict[str, str] = {"op11_merkle": merkle.MERKLE_SQL}
