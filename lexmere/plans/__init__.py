"""The registered queries and their oracles."""
