"""Named queries composed from the operators, and their reference SQL."""

#: Modules here, each with QUERIES and ORACLE.
CORE = ["evaluation", "deals", "texts", "corpora", "point_in_time"]
