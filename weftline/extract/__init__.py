"""Source code to rows."""
