"""Training-data operators: language, markup, duplicates, tokens, mixing and quality at corpus scale."""
