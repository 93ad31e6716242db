"""DataFrame operators: identity, duplicates, linking, vocabularies, views, history, levels, checks."""
