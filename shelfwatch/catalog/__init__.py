"""Registry of runnable queries and their independent SQL oracles."""
