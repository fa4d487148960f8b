"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from tellur.llm import decontaminate, htmltext, licenses, minhash, mixing, negatives, quality, simhash, tokens, topk, toxicity, warc, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_topk": topk.op2_topk,
    "op3_tokens": tokens.op3_tokens,
    "op4_html": htmltext.op4_html,
    "op5_warc": warc.op5_warc,
    "op6_mix": mixing.op6_mix,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_licenses": licenses.op9_licenses,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_negatives": negatives.op11_negatives,
    "op12_whitening": whitening.op12_whitening,
    "op13_minhash": minhash.op13_minhash,
}
ORACLES = {"op2_topk": topk.ORACLE, "op5_warc": warc.ORACLE, "op6_mix": mixing.ORACLE, "op9_licenses": licenses.ORACLE, "op11_negatives": negatives.ORACLE, "op13_minhash": minhash.ORACLE}
