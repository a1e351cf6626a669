"""Table operators: quality, profiles, association, text, mining, series, vectors, learning."""
