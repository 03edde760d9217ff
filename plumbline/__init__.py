"""Set-based checking of query-agent answers on Spark: scopes, audits, result comparison, claims and roll-ups."""
