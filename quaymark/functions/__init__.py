"""Column functions: casing, numbering, matching, scoring."""
