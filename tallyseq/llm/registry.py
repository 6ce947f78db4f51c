"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, binary_tokens, bpe, decontaminate, media, quality, sharding, simhash, spelling, suffix_tree, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_simhash": simhash.op2_simhash,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op4_media": media.op4_media,
        "op5_suffix_tree": suffix_tree.op5_suffix_tree,
        "op6_histogram_sharding": sharding.op6_histogram_sharding,
        "op7_binary_tokens": binary_tokens.op7_binary_tokens,
        "op8_warc_fixity": warc.op8_warc_fixity,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_alignment": alignment.op11_alignment,
        "op12_quality": quality.op12_quality,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.OP1_SQL, "op8_warc_fixity": warc.OP8_SQL, "op10_decontaminate": decontaminate.OP10_SQL}
