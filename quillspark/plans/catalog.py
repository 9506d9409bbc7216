"""Imports every module that registers queries."""

from quillspark.plans import form_queries, form_table_queries, grid_queries, html_queries, legacy_queries, line_queries, markup_queries, more_queries, stats_queries, submission_queries, text_queries  # noqa: F401
