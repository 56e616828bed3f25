"""Thresholds of the whole job, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # trimming
    len_cut_match: int = 10
    len_cut_trim: int = 10
    mismatch_allowance: int = 0
    # alignments with a lower score (a base 1, a mismatch -4, a gap -6 and -1 a base) are not reported, so they never reach trimming
    least_score: int = 20
    # clustering and pairing, in bases
    range_allowance: int = 1000
    pair_window: int = 100
    max_tsd: int = 20
    # calls
    required_junction_reads: int = 1
    min_support_only: int = 2
    fullread_extend: int = 10
    false_fraction: float = 0.3
    # reference elements and genotypes
    boundary_window: int = 5
    span_margin: int = 5
    # physical layout: bases in a clustering or range-join bin, in a region of stored alignments,
    # in a genome tile and its overlap
    cluster_bin: int = 1_000_000
    long_island: int = 2_000  # positions from which on an island is paired over bins of island_bin bases
    island_bin: int = 50_000
    range_bin: int = 10_000
    region: int = 1_000_000
    tile: int = 65_536
    tile_overlap: int = 64


DEFAULT = Params()
