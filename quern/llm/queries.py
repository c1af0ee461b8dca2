"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import langid, licenses, linededup, media, mixing, mtree, packing, quality, simhash, urlfilter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_language_id": langid.op2_language_id,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_quality": quality.op4_quality,
    "op5_packing": packing.op5_packing,
    "op6_simhash": simhash.op6_simhash,
    "op7_top_k": mtree.op7_top_k,
    "op8_media_columns": media.op8_media_columns,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filter": urlfilter.op10_url_filter,
}

ORACLE_SQL = {
    "op3_line_dedup": linededup.OP3_SQL,
    "op7_top_k": mtree.OP7_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op10_url_filter": urlfilter.OP10_SQL,
}
