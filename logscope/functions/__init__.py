"""logscope."""
