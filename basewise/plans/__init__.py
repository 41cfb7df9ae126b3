"""The three programs: run folder to pairs, pairs to records, records to files."""
