"""Named queries: one module per area, each pairing a DataFrame plan with its check in SQL where SQL can say it."""
