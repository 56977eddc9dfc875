"""Jobs (multi-operator chains) and the query registry with SQL oracles."""
