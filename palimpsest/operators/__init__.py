"""DataFrame operators: joins, aggregations, extraction, decoding, rules."""
