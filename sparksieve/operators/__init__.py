"""Rule tables and longest-match joins."""
