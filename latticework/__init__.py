"""latticework: molecular-graph analytics as Spark relations."""
