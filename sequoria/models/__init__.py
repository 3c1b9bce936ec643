"""Model families and their evaluation."""
