"""DataFrame operators: joins, rankings, quantiles, profiles, keys, shaping."""
