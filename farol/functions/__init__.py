"""Column functions: text cleaning, casts, dates, ratios, pair scores."""
