"""Reusable DataFrame operators that stay safe on hot keys."""
