"""DataFrame operators over draw records."""
