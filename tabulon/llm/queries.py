"""The queries that this subpackage registers, and their SQL."""

from __future__ import annotations

from . import bpe, jpeg, langid, licenses, mixing, pii, simhash, sketches, token_counts, warc

QUERIES = {
    "op1_language": langid.op1_language, "op2_token_counts": token_counts.op2_token_counts, "op3_media": jpeg.op3_media, "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash, "op6_pii": pii.op6_pii, "op7_licenses": licenses.op7_licenses, "op8_bpe": bpe.op8_bpe,
    "op9_warc": warc.op9_warc, "op10_fingerprints": sketches.op10_fingerprints,
}

ORACLES = {"op4_mixing": mixing.ORACLE, "op7_licenses": licenses.oracle(), "op9_warc": warc.ORACLE}
