"""Part of granula."""
