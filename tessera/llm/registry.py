"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import decontaminate, exact_dedup, html_extract, langid, licenses, line_dedup, mix_sources, near_dedup, packing, periodic_runs, pii, ranked_search, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mix_sources": mix_sources.op2_mix_sources,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_extract": html_extract.op4_html_extract,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_warc": warc.op8_warc,
    "op9_langid": langid.op9_langid,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_pattern_packing": packing.op11_pattern_packing,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES = {
    "op2_mix_sources": mix_sources.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op8_warc": warc.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op13_ranked_search": ranked_search.SQL,
}
