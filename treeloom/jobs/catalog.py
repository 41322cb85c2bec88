"""All queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from treeloom.jobs import changes, context, detectors, extraction, extras, mapping, prompts, reads, replies, review, selection, spans, star, tagging

QUERIES = mapping.QUERIES | selection.QUERIES | spans.QUERIES | review.QUERIES | extras.QUERIES | context.QUERIES | star.QUERIES | tagging.QUERIES | replies.QUERIES | prompts.QUERIES | detectors.QUERIES | reads.QUERIES | extraction.QUERIES | changes.QUERIES
ORACLE_SQL = mapping.ORACLE | selection.ORACLE | spans.ORACLE | review.ORACLE | extras.ORACLE | context.ORACLE | star.ORACLE | tagging.ORACLE | replies.ORACLE | prompts.ORACLE | detectors.ORACLE | reads.ORACLE | extraction.ORACLE | changes.ORACLE
