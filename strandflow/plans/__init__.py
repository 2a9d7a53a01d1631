"""Registered queries: each restates an operator over the driver's tables, with SQL for the same rows."""
