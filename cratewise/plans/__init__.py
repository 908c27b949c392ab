"""Plan-shaping helpers: skew-proof ranking, ordered scans, broadcast and lineage guards."""
