"""Scalar rules on reads, alignments and calls, as functions from columns to columns."""

from .alignment import boundary_score, cigar_length, match_counts, reference_span
from .annotation import gff_attribute, intact_element, strip_parens
from .calls import avg_flankers, classify_status, feature_id, junction_info, te_orientation, tsd_interval, tsd_text, window_overlap
from .names import split_mate, strip_junction_tag, strip_tag
from .sequence import parse_tags, reverse_complement, trim_read

__all__ = [
    "avg_flankers", "boundary_score", "cigar_length", "classify_status", "feature_id", "gff_attribute", "intact_element", "junction_info",
    "match_counts", "parse_tags", "reference_span", "reverse_complement", "split_mate", "strip_junction_tag", "strip_parens", "strip_tag",
    "te_orientation", "trim_read", "tsd_interval", "tsd_text", "window_overlap",
]
