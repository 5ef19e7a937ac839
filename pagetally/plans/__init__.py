"""Ready reports: each takes the raw event table, the common parameters and, if wanted, the key table."""
