"""DataFrame operators: joins, aggregations, rankings, splits, fits and decisions."""
