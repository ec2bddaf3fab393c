"""Content-inspection analytics over DataFrames: sniff, unpack, decode, match, enrich, score."""
