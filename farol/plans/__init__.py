"""Named jobs: star and flat loads, flat views, corpus questions, reports."""
