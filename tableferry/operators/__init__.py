"""DataFrame-to-DataFrame operators: audits, profiles, numbering, comparison and upsert."""
