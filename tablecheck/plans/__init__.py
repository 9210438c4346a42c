"""Working with many checks: catalogs, profiles, proposals, suites, history."""
