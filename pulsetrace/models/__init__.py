"""Model specifications, fitting, scoring and storage."""
