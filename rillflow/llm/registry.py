"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from rillflow.llm import ann, decontam, html, langid, licenses, linededup, mixing, pii, prefixes, runs, simhash, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_html": html.op2_html,
    "op3_warc": warc.op3_warc,
    "op4_mix": mixing.op4_mix,
    "op5_licenses": licenses.op5_licenses,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_lines": linededup.op7_lines,
    "op8_langid": langid.op8_langid,
    "op9_ann": ann.op9_ann,
    "op10_pii": pii.op10_pii,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_runs": runs.op12_runs,
    "op13_prefixes": prefixes.op13_prefixes,
}

SQL = {"op3_warc": warc.OP3_SQL, "op6_decontaminate": decontam.OP6_SQL, "op7_lines": linededup.OP7_SQL, "op9_ann": ann.OP9_SQL, "op13_prefixes": prefixes.OP13_SQL}
