"""SQL twins of the registered queries, for checking results in another engine."""

from __future__ import annotations

from lyceum.oracle import academics, operations

ORACLE: dict[str, str] = {**academics.SQL, **operations.SQL, "view_scholarship_at_risk": academics.SQL["scholarship_at_risk"]}
