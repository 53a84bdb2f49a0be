"""The pN_ queries: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runeworks.llm import bpe, budget, caps, defects, mixing, overlap, packing, quotas, textstats
from runeworks.sources.tables import table


def _on(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return operator(*(table(spark, folder, t) for t in tables))

    query.__doc__ = operator.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "p1_found": _on(mixing.unmet_targets, "puzzles", "mix_targets"),
        "p1_mixture": _on(mixing.mix_sources, "puzzles", "mix_targets"),
        "p1_shares": _on(mixing.mixture_shares, "puzzles", "mix_targets"),
        "p2_found": _on(overlap.overlap_pairs, "puzzles"),
        "p2_members": _on(overlap.overlap_members, "puzzles"),
        "p2_report": _on(overlap.overlap_report, "puzzles"),
        "p3_budget": _on(budget.token_budget, "documents", "sft_records"),
        "p4_found": _on(caps.dropped_by_caps, "puzzles", "program_signatures", "bucket_caps"),
        "p4_capped": _on(caps.cap_contributors, "puzzles", "program_signatures", "bucket_caps"),
        "p5_found": _on(quotas.missed_quotas, "puzzles", "sample_quotas"),
        "p5_sample": _on(quotas.quota_sample, "puzzles", "sample_quotas"),
        "p5_report": _on(quotas.quota_report, "puzzles", "sample_quotas"),
        "p6_found": _on(defects.broken_pairs, "sft_records", "eval_records", "puzzles"),
        "p7_ids": _on(bpe.encode_documents, "documents"),
        "p8_packed": _on(packing.pack_documents, "documents", "pack_limits"),
        "p8_report": _on(packing.packing_report, "documents", "pack_limits"),
        "p9_found": _on(textstats.not_prose, "documents"),
        "p9_statistics": _on(textstats.text_statistics, "documents"),
    }
