"""A hand-written cluster -> tag matrix used as the weak-label input.

The reference reads such a Markdown table written by a person after reading
the cluster reports; it is an input relation, not something computed.  This
one covers the ten clusters of the driver's ``embeddings`` table (subcluster
0 of each) and includes the quirks the parser must handle: a header and a
divider row, a row with three cells, a row without tags, a duplicate key
(the later line wins) and a line without the leading ``"| "``.
"""

TAG_MATRIX_MD = """\
# Behavior tags per subcluster

| Subcluster | Behavior tags | Secondary tags | Notes |
| --- | --- | --- | --- |
| 0.0 | `direct_answer` | `concise` | short replies |
| 1.0 | `structured_steps`, `enumeration` | `direct_answer` | lists |
| 2.0 | `hedged` | `concise`, `hedged` | careful |
| 3.0 | `polite_opening` | `direct_answer` | warm |
| 4.0 | `revision_help`, `structured_steps` | `` | drafts |
| 5.0 | `enumeration` | `hedged` | options |
| 6.0 | `direct_answer`, `concise` | `polite_opening` | |
| 7.0 | `structured_steps` | `revision_help` | how-to |
| 8.0 | `hedged`, `polite_opening` | `enumeration` | mixed |
| 9.0 | `concise` | `direct_answer` | terse |
| 9.1 | | | no tags here |
| 3.0 | `polite_opening`, `hedged` | `direct_answer` | later line wins |
| 2.0 | `hedged` | three cells only |
|0.1 | `ignored` | `ignored` | no leading pipe-space |
"""

# Parsed form of the table above (top, sub, sorted distinct tags), kept next to
# the text so the SQL oracle can use it as a VALUES list.
TAG_MATRIX_ROWS = [
    (0, 0, ["concise", "direct_answer"]),
    (1, 0, ["direct_answer", "enumeration", "structured_steps"]),
    (2, 0, ["concise", "hedged"]),
    (3, 0, ["direct_answer", "hedged", "polite_opening"]),
    (4, 0, ["revision_help", "structured_steps"]),
    (5, 0, ["enumeration", "hedged"]),
    (6, 0, ["concise", "direct_answer", "polite_opening"]),
    (7, 0, ["revision_help", "structured_steps"]),
    (8, 0, ["enumeration", "hedged", "polite_opening"]),
    (9, 0, ["concise", "direct_answer"]),
]


def values_sql() -> str:
    rows = ", ".join(
        f"({t}, {s}, [{', '.join(repr(x) for x in tags)}])" for t, s, tags in TAG_MATRIX_ROWS
    )
    return f"(VALUES {rows}) tm(top_cluster, subcluster, tags)"
