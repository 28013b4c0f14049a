"""Part of ridgeline."""
