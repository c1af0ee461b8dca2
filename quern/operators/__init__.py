"""Index and statistics builders, and the relational operators on indexed tables."""
