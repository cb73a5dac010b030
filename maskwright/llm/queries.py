"""All queries of this subpackage, and the SQL they are checked against."""

from maskwright.llm import p1_consensus, p2_overlap, p3_sample, p4_lookalike, p5_pii, p6_leak, p7_mix, p8_level

_ALL = (p1_consensus, p2_overlap, p3_sample, p4_lookalike, p5_pii, p6_leak, p7_mix, p8_level)
QUERIES = {k: f for m in _ALL for k, f in m.QUERIES.items()}
ORACLE = {k: q for m in _ALL for k, q in m.ORACLE.items()}
