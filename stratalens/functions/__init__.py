"""See the README for this part's contents."""
