"""Spark jobs for chip-layout data: geometry, nets, transistors, netlists and signal traces."""
