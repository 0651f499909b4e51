"""DataFrame operators: each one a lazy plan over panels, items or the corpus."""
