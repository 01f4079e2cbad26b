"""Stage operators: profile, clean, standardize, match, export."""
