"""Registered queries, the end-to-end evidence plan and reports."""
