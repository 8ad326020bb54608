"""Plans: pipelines of components, settings, and reports."""
