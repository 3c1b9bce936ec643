"""Training-data operators: tokens, near copies, language, quality, licences, mixing and URLs."""
