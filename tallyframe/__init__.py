"""tallyframe: register reconciliation on Spark DataFrames.

Two registers (for example services delivered and charges levied) are paired by key, each compared
attribute is flagged, matches are separated from non-matches, one-sided records are found, children
are rolled up to parents, values are looked up in numeric bands, the latest effective record is
picked and attribute-value rows are joined.  Every operator is plain DataFrame code: joins, grouped
aggregates and column expressions, planned by Catalyst.

Layout:
    sources/    table loading, code normalisation, report sink, domain views
    functions/  column expressions (predicates, flags, text, integer/decimal arithmetic)
    operators/  joins, keyed aggregates, reconciliation
    plans/      named datasets, reports, query registry and SQL oracle
"""

from tallyframe.session import AS_OF, build_session, checkpoint_dir
from tallyframe.sources.domain import refresh, update

__all__ = ["AS_OF", "build_session", "checkpoint_dir", "refresh", "update"]
