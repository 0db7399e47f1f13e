"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe, decontaminate, extract, media, near_dedup, pii, quality, repeats, sharding, spelling, token_groups, url_filter, vector_codes

QUERIES: dict[str, Callable] = {
    "op1_sharding": sharding.query,
    "op2_html_extraction": extract.query,
    "op3_byte_bpe": bpe.query,
    "op4_quality_classifier": quality.query,
    "op5_pii": pii.query,
    "op6_near_dedup": near_dedup.query,
    "op7_url_filter": url_filter.query,
    "op8_decontamination": decontaminate.query,
    "op9_media": media.query,
    "op10_repeats": repeats.query,
    "op11_vector_codes": vector_codes.query,
    "op12_spelling": spelling.query,
    "op13_token_groups": token_groups.query,
}

SQL: dict[str, str] = {
    "op6_near_dedup": near_dedup.SQL, "op7_url_filter": url_filter.SQL, "op8_decontamination": decontaminate.SQL,
    "op11_vector_codes": vector_codes.SQL, "op12_spelling": spelling.SQL,
    "op13_token_groups": token_groups.SQL,
}
