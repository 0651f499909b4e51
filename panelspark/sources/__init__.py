"""Reading pages, result sets, panels and the corpus; writing them back."""
