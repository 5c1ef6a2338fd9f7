"""Evidence audits."""
