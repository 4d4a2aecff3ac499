"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, chat, extract, jaccard, outliers, packing, quality, secrets, sstable, topk


def queries() -> dict:
    return {
        "op1_quality": quality.query,
        "op2_outliers": outliers.query,
        "op3_jaccard": jaccard.query,
        "op4_bpe": bpe.query,
        "op5_topk": topk.query,
        "op6_sstable": sstable.query,
        "op7_extract": extract.query,
        "op8_secrets": secrets.query,
        "op9_packing": packing.query,
        "op10_chat": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": topk.SQL, "op10_chat": chat.SQL}
