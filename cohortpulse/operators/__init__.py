"""DataFrame operators that take column names and predicates, for any entity / fact star."""
